"""Byte-level BPE encoding and decoding by a depth-first walk of a trie of distinct words.

The last token of the encoding of every prefix determines the encoding: it is the one vocabulary token that
ends there and that the merges leave apart from the last token of the prefix before it. New words are visited
in sorted order, which is the depth-first order of their trie; the states of the prefix shared with the word
before are kept, so each trie edge is computed once.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from taintloom.llm.common import prepare, take_cache, utf8

TOKENIZER = "byte_bpe_50k.json"
# the published pattern of this tokenizer family
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words, and pairs of tokens, that a worker remembers.
REMEMBERED = 1_200_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            loaded = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = loaded["model"]["vocab"]
        self.token = {i: raw(t) for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        self.merges: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for merge in loaded["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[a + b]
            self.merges[vocab[a], vocab[b]] = made
            self.left[made], self.right[made] = vocab[a], vocab[b]
        ranks = list(self.left)
        if ranks != sorted(ranks) or min(ranks) < 256:
            raise ValueError("ids of merged tokens must grow with the rank of their merge")
        # tokens by their bytes from the last to the first
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for i in sorted(set(self.left) | set(range(256))):
            node = 0
            for b in reversed(self.token[i]):
                node = self.step.setdefault(node << 8 | b, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = i
        self.apart: dict[int, bool] = {}
        self.ids_of: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge across their border comes before those that make the tokens a and b.

        Merges are undone from the latest; what stands at the border then could have merged only
        earlier than the last undone one, or along with it where that one lies to the right.
        """
        limit = 1 << 62
        while True:
            made = self.merges.get((a, b))
            if made is not None and made < limit:
                return False
            later = max(a, b)
            if later < 256:
                return True
            if a > b:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def walk(self, words: list[bytes]):
        """The ids of each word; words are sorted and distinct."""
        step, ends, apart = self.step, self.ends, self.apart
        if len(apart) > REMEMBERED:
            apart.clear()
        last: list[int] = [0]  # last token of each prefix of the word before
        size: list[int] = [0]
        before = b""
        for word in words:
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                node, found = 0, []
                for at in range(i - 1, -1, -1):
                    node = step.get(node << 8 | word[at])
                    if node is None:
                        break
                    if (t := ends[node]) >= 0:
                        found.append((t, i - at))
                for t, n in reversed(found):
                    if n == i:
                        break
                    key = last[i - n] << 20 | t
                    ok = apart.get(key)
                    if ok is None:
                        ok = apart[key] = self.stay_apart(last[i - n], t)
                    if ok:
                        break
                last.append(t)
                size.append(n)
            ids, i = [], len(word)
            while i:
                ids.append(last[i])
                i -= size[i]
            before = word
            yield ids[::-1]

    def forget(self) -> None:
        self.ids_of, self.other = {}, {}

    def learn(self, words: set[str]) -> None:
        """Remember each word's ids, as decimals each with a comma; and what they decode to, where that is not the word."""
        if len(self.ids_of) > REMEMBERED:
            self.forget()
        new = sorted([(w.encode(), w) for w in words.difference(self.ids_of)])
        for (raw, w), ids in zip(new, self.walk([b for b, _ in new])):
            self.ids_of[w] = (",".join(map(str, ids)) + ",").encode()
            if (decoded := b"".join([self.token[i] for i in ids])) != raw:
                self.other[w] = decoded

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as decimals joined by commas, decoded bytes) of each text.

        Decoding too is done once for each distinct word; a text of words that decode to themselves decodes to itself.
        """
        special = [any(s in t for s in self.specials) for t in texts]
        # a text with special tokens: its parts, every second one such a token
        lists = [[p if k % 2 else self.pattern.findall(p) for k, p in enumerate(self.special.split(t))] if s else self.pattern.findall(t) for s, t in zip(special, texts)]
        self.learn(set().union(*[ws for s, ws in zip(special, lists) if not s], *[p for s, ws in zip(special, lists) if s for p in ws[::2]]))
        ids, out = self.ids_of.__getitem__, []
        for s, ws, t in zip(special, lists, texts):
            if s:
                found = b"".join([b"%d," % self.specials[p] if k % 2 else b"".join(map(ids, p)) for k, p in enumerate(ws)])
                ws = [w for k, p in enumerate(ws) for w in ([p] if k % 2 else p)]
            else:
                found = b"".join(map(ids, ws))
            decoded = b"".join([self.other.get(w) or w.encode() for w in ws]) if self.other else t.encode()
            out.append((found[:-1], decoded))
        return out

    def ids(self, text: str) -> list[int]:
        found = self.encode([text])[0][0]
        return [int(x) for x in found.split(b",")] if found else []

    def decode(self, ids: list[int]) -> str:
        special = {i: s.encode() for s, i in self.specials.items()}
        return b"".join([self.token[i] if i in self.token else special[i] for i in ids]).decode("utf-8", "replace")


_made: dict[str, TrieBpe] = {}


def trie_bpe(path: str) -> TrieBpe:
    if path not in _made:
        _made[path] = TrieBpe(path)
    return _made[path]


_DIGEST = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def _digests(path: str):
    @F.pandas_udf(_DIGEST)
    def run(texts: pd.Series) -> pd.DataFrame:
        bpe, rows, waiting, size = trie_bpe(path), [], [], 0
        take_cache("bpe", bpe.forget)

        def flush() -> None:
            for ids, decoded in bpe.encode(waiting):
                plain = decoded.decode("utf-8", "replace").encode()
                rows.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest()))
            waiting.clear()

        for t in texts:
            waiting.append(t.decode())
            size += len(t)
            if size > 1 << 20:
                flush()
                size = 0
        flush()
        return pd.DataFrame(rows, columns=_DIGEST.names)

    return run


def _ids(path: str):
    from pyspark.sql.types import ArrayType, IntegerType

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        bpe = trie_bpe(path)
        return pd.Series([bpe.ids(t.decode()) for t in texts])

    return run


def _texts(path: str):
    @F.pandas_udf(StringType())
    def run(ids: pd.Series) -> pd.Series:
        bpe = trie_bpe(path)
        return pd.Series([None if x is None else bpe.decode(list(x)) for x in ids])

    return run


def encode(text: str | Column, tokenizer: str) -> Column:
    """The ids of a text column: array<int>; null and empty texts have none."""
    return _ids(tokenizer)(utf8(text))


def decode(ids: str | Column, tokenizer: str) -> Column:
    """The text of an array of ids, special tokens included; bytes that are no UTF-8 become U+FFFD; null stays null."""
    return _texts(tokenizer)(ids)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; columns of these names are replaced.

    A null text is empty: no ids. Rows are independent, so repeats, ties and empty tables need no care.
    """
    prepare(docs.sparkSession)
    out = docs.withColumn("__bpe", _digests(tokenizer)(utf8(text)))
    return out.withColumns({c: F.col(f"__bpe.{c}") for c in _DIGEST.names}).drop("__bpe")
