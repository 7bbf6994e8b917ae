"""Personal data in text, found by weak supervision, with SQL functions alone.

Four base patterns fix the spans of e-mail addresses, IP addresses, card and phone numbers. Looser
patterns add candidates: phone numbers without a country code, spelled-out addresses and secrets. Regex,
gazetteer and context labelers vote on every span; expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is; its posteriors train a naive Bayes classifier over the
span's shape, which accepts or rejects the candidates. Base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintloom.llm.common import forget, prepare, written

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")

# A match can only start where a run of its characters starts or where the last match ended, so every
# character is tried once; possessive repeats never backtrack and, in Java, never recurse.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LOCAL_PHONE = r"(?<![A-Za-z0-9_+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![A-Za-z0-9_-])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}"
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}"

# gazetteers and context words of the labelers
ENDINGS = r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
PREFIXES = r"^(?:sk|pk|ghp|gho|xox[bp]|AKIA|eyJ)"
CONTEXT = {
    0: r"(?i)(?:mail|contact|write|address)\W*\w{0,8}\W*$",
    1: r"(?i)(?:\bip|host|server|addr\w*|from)\W*$",
    2: r"(?i)(?:card|visa|credit|payment|pay)\W*\w{0,8}\W*$",
    3: r"(?i)(?:phone|tel|call|mobile|fax|contact)\W*\w{0,8}\W*$",
    4: r"(?i)(?:token|key|secret|password|passwd|pwd|bearer|api)\w{0,8}[\x20\"']{0,3}[=:]?[\x20\"']{0,3}$",
}
AGAINST = r"(?i)(?:version|isbn|page|https?://\S*|\$|€|#)\x20?$"
VOTERS = 6
ROUNDS = 40


def _chars(array: Column) -> Column:
    return F.transform(array, lambda x: F.char_length(x).cast("long"))


SPAN = "array<struct<kind:int,start:long,stop:long,hit:string>>"
#: Spans that a fold gathers before it sets them aside, so that appending stays near linear.
BLOCK = 256


def _hits(text: Column, pattern: str, kind: int, hint: Column) -> Column:
    """The leftmost matches that do not overlap, as spans in code points: a fold over gaps and matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(SPAN)
    state = lambda at, now, done: F.struct(at.alias("at"), now.alias("now"), done.alias("done"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["g"]
        stop = start + F.char_length(x["t"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), x["t"].alias("hit")))
        full = F.size(a["now"]) >= BLOCK
        return state(stop, F.when(full, span).otherwise(F.concat(a["now"], span)), F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))

    # one more gap than matches: the null match at the end is not a step
    steps = F.arrays_zip(F.slice(_chars(gaps), F.lit(1), F.size(gaps) - 1).alias("g"), hits.alias("t"))
    spans = F.aggregate(steps, state(F.lit(0).cast("long"), none, F.array().cast(f"array<{SPAN}>")), step, lambda a: F.concat(F.flatten(a["done"]), a["now"]))
    return F.when(hint, spans).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def one(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + one(i)) % 10 == 0


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """df with __email, __ip, __card, __phone: the base spans of each kind."""
    t = F.col(text)
    df = df.withColumn("__digit", t.rlike("[0-9]"))
    digit = F.col("__digit")
    raw = df.withColumns({
        "__email": _hits(t, EMAIL, 0, F.contains(t, F.lit("@"))),
        "__ip": _hits(t, IP, 1, digit),
        "__card": _hits(t, CARD, 2, digit),
        "__phone": _hits(t, PHONE, 3, digit & F.contains(t, F.lit("+"))),
    })
    n = lambda x: F.char_length(_digits(x["hit"]))
    return raw.withColumns({
        "__ip": F.filter("__ip", lambda x: x["hit"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")),
        "__card": F.filter("__card", lambda x: F.when(n(x).between(13, 19), _luhn(_digits(x["hit"]))).otherwise(False)),
        "__phone": F.filter("__phone", lambda x: n(x).between(9, 15)),
    })


def _votes(x: Column, text: Column) -> Column:
    """One character for each labeler: 1 for, 0 against, - when it has nothing to say."""
    kind, hit = x["kind"], x["hit"]
    left = F.substring(text, F.greatest(x["start"] - 31, F.lit(1)).cast("int"), F.least(x["start"], F.lit(32)).cast("int"))
    after = F.substring(text, (x["stop"] + 1).cast("int"), F.lit(2))
    pick = lambda yes, no=None: F.when(yes, "1").when(no if no is not None else F.lit(False), "0").otherwise("-")
    by_kind = lambda f: F.coalesce(*[F.when(kind == k, f(k)) for k in range(len(NAMES))])
    digits = F.char_length(_digits(hit))
    shape = by_kind(lambda k: [
        pick(F.contains(hit, F.lit("@")), hit.rlike(r"\(|\[")),
        pick(~hit.rlike(r"^[01]\.|\.0+$"), hit.rlike(r"^0\.")),
        pick(_luhn(_digits(hit)), F.lit(True)),
        pick(digits.between(9, 15), ~digits.between(8, 15)),
        pick(hit.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z]).{20,})$"), hit.rlike(r"^[0-9_-]+$|[A-Za-z]{2,}[_-][A-Za-z]{2,}[_-]")),
    ][k])
    gazetteer = by_kind(lambda k: [
        pick(F.lower(hit).rlike(ENDINGS)), pick(hit.rlike(r"^(?:10|127|172|192)\."), F.lit(False)), pick(hit.rlike(r"^(?:4|5[1-5]|3[47]|6011)")), pick(hit.rlike(r"^(?:\+(?:1|33|34|44|49)\b|\(?0|\([2-9])")), pick(hit.rlike(PREFIXES)),
    ][k])
    context = by_kind(lambda k: pick(left.rlike(CONTEXT[k])))
    against = pick(F.lit(False), left.rlike(AGAINST))
    fence = pick(left.rlike(r"[\x20\"'<(\[=:,;]$|^$") & ~after.rlike(r"^[A-Za-z0-9_@]"), left.rlike(r"[A-Za-z0-9_@/]$") | after.rlike(r"^[A-Za-z0-9_@]"))
    spread = by_kind(lambda k: pick(hit.rlike(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"), hit.rlike(r"([A-Za-z0-9])\1{5,}")) if k in (0, 4) else pick(F.lit(False), hit.rlike(r"([0-9])\1{5,}")))
    return F.concat(shape, gazetteer, context, against, fence, spread)


def _shape(x: Column, text: Column) -> Column:
    """The classifier's features: length, share of digits, and the characters on either side, in classes."""
    side = lambda c: F.when(c == "", "e").when(c.rlike(r"^[A-Za-z]"), "a").when(c.rlike(r"^[0-9]"), "d").when(c.rlike(r"^\s"), "s").when(c.rlike("^[\"'=:(<\\[]"), "q").otherwise("o")
    left = F.when(x["start"] > 0, F.substring(text, x["start"].cast("int"), F.lit(1))).otherwise("")
    n = F.char_length(x["hit"])
    share = F.floor(F.char_length(_digits(x["hit"])) * 4 / n)
    return F.array(F.concat(F.lit("n"), F.least(F.floor(n / 6), F.lit(9)).cast("string")), F.concat(F.lit("d"), share.cast("string")), F.concat(F.lit("l"), side(left)), F.concat(F.lit("r"), side(F.substring(text, (x["stop"] + 1).cast("int"), F.lit(1)))))


def reliabilities(patterns: dict[tuple[int, str], float]) -> dict[tuple[int, str], float]:
    """Posterior of each (kind, votes), by expectation-maximisation over their counts.

    Each labeler has, for each kind, a chance of each of its three answers given that the span is
    personal data or not; a labeler's own answers start it: it is right in four cases of five.
    """
    out: dict[tuple[int, str], float] = {}
    for kind in {k for k, _ in patterns}:
        rows = [(v, n) for (k, v), n in patterns.items() if k == kind]
        prior = 0.5
        like = [{(c, a): {"1": (0.4, 0.1), "0": (0.1, 0.4), "-": (0.5, 0.5)}[a][1 - c] for c in (0, 1) for a in "10-"} for _ in range(VOTERS)]
        post: dict[str, float] = {}
        for _ in range(ROUNDS):
            for v, _n in rows:
                yes = math.log(prior) + sum(math.log(like[i][1, a]) for i, a in enumerate(v))
                no = math.log(1 - prior) + sum(math.log(like[i][0, a]) for i, a in enumerate(v))
                post[v] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
            total = sum(n for _, n in rows)
            weight = {1: sum(n * post[v] for v, n in rows), 0: sum(n * (1 - post[v]) for v, n in rows)}
            prior = min(0.98, max(0.02, (weight[1] + 1) / (total + 2)))
            # a few imagined votes keep a labeler that errs on no span here from being certain
            first = {"1": (4, 1), "0": (1, 4), "-": (5, 5)}
            like = [{(c, a): (first[a][1 - c] + sum(n * (post[v] if c else 1 - post[v]) for v, n in rows if v[i] == a)) / (10 + weight[c]) for c in (0, 1) for a in "10-"} for i in range(VOTERS)]
        out |= {(kind, v): p for v, p in post.items()}
    return out


def span_weights(rows: list[tuple[int, str, float, float]]) -> dict[str, float]:
    """Log odds of each feature of each kind, and of the kind, from (kind, feature, posterior mass, count); the
    feature of the kind itself is empty."""
    total = {k: (1.0 + n - mass, 1.0 + mass) for k, f, mass, n in rows if not f}
    out = {f"{k}": math.log(yes / no) for k, (no, yes) in total.items()}
    for k, f, mass, n in rows:
        if f:
            no, yes = total[k]
            out[f"{k}{f}"] = math.log((mass + 0.5) / (yes + 5)) - math.log((n - mass + 0.5) / (no + 5))
    return out


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __base (array of spans) and __all (base and accepted spans), sorted by kind and start.

    A null or empty text has no span. Repeated rows, ties and empty tables need no care: each row is
    judged alone, by weights that come from all rows. Spans count code points and exclude their end.
    """
    prepare(docs.sparkSession)
    own = ["__t", "__digit", "__email", "__ip", "__card", "__phone", "__extra", "__base", "__all"]
    df = base_spans(docs.drop(*own).withColumn("__t", F.coalesce(F.col(text), F.lit(""))), "__t")
    t = F.col("__t")
    loose = F.concat(
        _hits(t, SPELLED, 0, F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)"))),
        _hits(t, LOCAL_PHONE, 3, F.col("__digit")),
        _hits(t, TOKEN, SECRET, F.col("__digit")),
    )
    df = df.withColumns({"__base": F.concat("__email", "__ip", "__card", "__phone"), "__extra": loose}).drop("__email", "__ip", "__card", "__phone", "__digit")
    apart = F.filter("__extra", lambda c: ~F.exists("__base", lambda b: (b["start"] < c["stop"]) & (b["stop"] > c["start"])))
    df = df.withColumn("__extra", apart)
    seen = df.filter((F.size("__base") > 0) | (F.size("__extra") > 0))
    both = seen.select(F.explode(F.transform(F.concat("__base", "__extra"), lambda x: F.struct(x["kind"].alias("kind"), _votes(x, t).alias("votes"), _shape(x, t).alias("shape")))).alias("x"))
    # written: both counts below are read from it, not from the texts
    spans = written(both.groupBy("x.kind", "x.votes", "x.shape").agg(F.count("*").cast("double").alias("n")))
    # at most 3^VOTERS patterns for each of five kinds
    patterns = {(r.kind, r.votes): r.n for r in spans.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()}
    posterior = reliabilities(patterns)
    told = ", ".join(f"({k}, '{v}', {p!r}D)" for (k, v), p in posterior.items()) or "(-1, '', 0D)"
    likely = spans.sparkSession.sql(f"SELECT * FROM VALUES {told} AS p(kind, votes, likely)")
    masses = spans.join(F.broadcast(likely), ["kind", "votes"]).withColumn("mass", F.col("likely") * F.col("n"))
    # a row for the kind itself and one for each of its few features
    masses = masses.select("kind", F.explode(F.concat(F.array(F.lit("")), "shape")).alias("feature"), "mass", "n").groupBy("kind", "feature").agg(F.sum("mass").alias("mass"), F.sum("n").alias("n"))
    weights = span_weights([tuple(r) for r in masses.collect()])
    forget(spans)
    table = F.create_map(*[F.lit(x) for pair in (weights or {"": 0.0}).items() for x in pair])
    of = lambda key: F.coalesce(F.try_element_at(table, key), F.lit(0.0))

    def score(x: Column) -> Column:
        k = x["kind"].cast("string")
        return F.aggregate(_shape(x, t), of(k), lambda a, f: a + of(F.concat(k, f)))

    accepted = F.when(F.size("__extra") > 0, F.filter("__extra", lambda x: score(x) > 0)).otherwise(F.col("__extra"))
    df = df.withColumn("__all", F.array_sort(F.concat("__base", accepted)))
    return df.withColumn("__base", F.array_sort("__base")).drop("__extra", "__t")


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by its kind in brackets; null texts stay null."""
    df = find_pii(docs, text)
    # overlapping spans of different kinds are replaced as one, named after the first
    ordered = F.array_sort(F.transform("__all", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{n.upper()}]") for n in NAMES])
    t = F.col(text)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))
    fold = F.aggregate(
        ordered,
        start,
        lambda a, x: F.when(x["start"] < a["at"], F.struct(a["parts"].alias("parts"), F.greatest(a["at"], x["stop"]).alias("at"))).otherwise(
            F.struct(F.concat(a["parts"], F.array(F.substring(t, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.element_at(names, x["kind"] + 1))).alias("parts"), x["stop"].alias("at"))
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(t, (a["at"] + 1).cast("int"), F.char_length(t))),
    )
    return df.withColumn(text, F.when(F.size("__all") > 0, fold).otherwise(t)).drop("__base", "__all")
