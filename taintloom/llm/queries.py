"""One thin query for each operator: its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taintloom.llm.suffix_dedup import suffix_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taintloom.llm.pii import KINDS, find_pii, joined

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("__base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("__base"), 256).alias("base_sha256"), joined("__all").alias("spans"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taintloom.llm.simhash import simhash

    return simhash(table(spark, sf_dir, "documents"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from taintloom.llm.packing import TOKENIZER, pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from taintloom.llm.bpe import TOKENIZER, round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path(TOKENIZER)).drop("text")


@query
def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taintloom.llm.media import stored_digest

    return stored_digest(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taintloom.llm.chat import format_chats, loss_text

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    clash = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = format_chats(turns.unionByName(clash)).withColumn("loss", loss_text("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taintloom.llm.quality import score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


# formatted_chars: 3 + 6 + 4 characters of marks a turn, one more where role or text holds a control string; there
# each \, < and [ of them takes two characters
ORACLES["op7_chat"] = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, len(list_filter(['<s>', '</s>', '[INST]', '[INST!]'], lambda c: contains(role, c) OR contains(text, c))) > 0 AS clash,
           length(role || text) AS n, length(regexp_replace(role || text, '[^<\\[\\\\]', '', 'g')) AS more
    FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + 13 + CASE WHEN clash THEN 1 + more ELSE 0 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taintloom.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


# these pages have one article, blocks h1 and p, and four character references
ORACLES["op3_html"] = r"""
WITH cut AS (
    SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages
), parts AS (
    SELECT page_id, url, unnest(regexp_split_to_array(a, '</?(?:p|h1)>')) AS part, generate_subscripts(regexp_split_to_array(a, '</?(?:p|h1)>'), 1) AS i FROM cut
), clean AS (
    SELECT page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(part, '<br>', ' ', 'g'), '</?b>', '', 'g'),
        '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM parts
), texts AS (
    SELECT page_id, url, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> ''), '') AS text FROM clean GROUP BY page_id, url
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""


@query
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taintloom.llm.embeddings import near_embeddings

    return near_embeddings(table(spark, sf_dir, "embeddings"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
