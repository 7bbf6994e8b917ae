"""Packing of tokenised documents into sequences by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most `size` ids: full pieces, and what is left over. Only the histogram
of piece lengths reaches the driver (at most `size` numbers). Lengths are placed longest first, each time into
the packs that hold the fewest ids; packs of equal content are one entry with a count, so the work depends
on `size` and not on the number of documents. The k-th piece of a length takes the k-th place planned for
that length: pieces get their rank within their length, and a search over the plan gives sequence and offset.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taintloom.llm.common import prepare, take_cache, written

SIZE = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
#: Distinct parts of words in each of the two generations that a worker remembers.
REMEMBERED = 600_000
#: Pieces of one length that are ranked together at most, if all had one; there are GROUPS groups at least.
RANKED = 200_000
GROUPS = 64

# The tokenizer files whose splitting is known here, by their settings
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
KNOWN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

# Characters that composing leaves alone and whose lower case needs no context, white space that all agree on
_OTHER = re.compile(r"[^\t\n\v\f\r -~À-ÖØ-öø-ÿ]|<\|")
# what the tokenizer splits such text into, in lower case
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def splits_words(settings: dict) -> bool:
    """Whether this tokenizer file splits as is known here, at white space too, with added tokens that start in <| alone."""
    plain = all(t["content"].startswith("<|") and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(map(str.isspace, t["content"])) for t in settings.get("added_tokens") or [])
    split = {"type": "Sequence", "pretokenizers": [KNOWN_SPLIT, KNOWN_BYTES]}
    return plain and settings.get("normalizer") == KNOWN_NORMALIZER and settings.get("pre_tokenizer") == split


class WordIds:
    """The ids of a text, as little-endian bytes, from those of its parts, which are remembered.

    A tokenizer that splits as is known here never joins over white space, so a text's ids are those of its words;
    a text of simple characters alone is split into the tokenizer's own parts at once. Any other tokenizer gets
    whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = splits_words(json.load(f))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._ids(texts)
        lists = [t.encode().split() if _OTHER.search(t) else _PARTS.findall(t.lower()) for t in texts]
        lists = [[w.decode() for w in ws] if ws and isinstance(ws[0], bytes) else ws for ws in lists]
        known = self.known
        new = set().union(*lists).difference(known)
        if len(known) + len(new) > REMEMBERED:
            # words in use move on to the next generation, the others are forgotten with the last one
            self.older, self.known = known, {}
            known, new = self.known, set().union(*lists)
        older = self.older
        again = [w for w in new if w in older] if older else []
        known.update([(w, older[w]) for w in again])
        new = list(new.difference(again))
        known.update(zip(new, self._ids(new)))
        return [b"".join([known[w] for w in ws]) for ws in lists]


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]


def _pieces(path: str, size: int, with_ids: bool):
    def run(batches):
        encoder = word_ids(path)
        take_cache("packing", encoder.forget)
        made = 0
        for batch in batches:
            doc, start, length, crc, total, kept = [], [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 128):
                for i, ids in enumerate(encoder.encode(texts[lo : lo + 128]), lo):
                    ids += END.to_bytes(4, "little")
                    n = len(ids) // 4
                    for at in range(0, n, size):
                        piece = ids[4 * at : 4 * (at + size)]
                        doc.append(i)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            kept.append(piece)
            columns = [batch.column(0).take(pa.array(doc, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns.append(pa.array(range(made, made + len(doc)), pa.int64()))
            names.append("__nth")
            made += len(doc)
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def plan(histogram: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, count, first sequence, offset) and the number of sequences.

    Each row: that many pieces of the length, from the rank on, go to as many sequences in a row.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    packs: dict[int, list[tuple[int, int]]] = {}
    filled: list[int] = []  # a heap of the contents of packs
    made = 0

    def put(content: int, first: int, count: int) -> None:
        if content not in packs:
            packs[content] = []
            heapq.heappush(filled, content)
        packs[content].append((first, count))

    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        left, rank = histogram[length], 0
        while left:
            if not filled or filled[0] + length > size:
                rows.append((length, rank, left, made, 0))
                put(length, made, left)
                made += left
                break
            content = filled[0]
            first, count = packs[content].pop()
            if not packs[content]:
                del packs[content]
                heapq.heappop(filled)
            used = min(count, left)
            rows.append((length, rank, used, first, content))
            put(content + length, first, used)
            if used < count:
                put(content, first + used, count - used)
            left -= used
            rank += used
    return np.array(rows, np.int64).reshape(-1, 5), made


def _placed(rows: np.ndarray):
    def run(batches):
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        length, rank, _, sequence, offset = rows[order].T
        keys = (length << 48) + rank
        for batch in batches:
            own = batch.column("__rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 48) + own, side="right") - 1
            kept = batch.drop_columns(["__rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence[at] + own - rank[at]), pa.array(offset[at])], [*kept.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids,
    the ids as little-endian 32-bit numbers. tokenizer is the path of its file on every machine.

    A null or empty text is the end id alone. Rows with equal or null ids are documents of their own.
    An empty table gives an empty table. Of docs, only the two named columns are read.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    ids = ", ids binary" * with_ids
    # __nth: a piece's number in the task that made it, which deals pieces of equal or null ids to all groups
    pieces = written(source.mapInArrow(_pieces(tokenizer, size, with_ids), schema + ", __nth long" + ids))
    groups = max(GROUPS, pieces.count() // RANKED)
    pieces = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "__nth"), F.lit(groups)))
    counts = written(pieces.groupBy("length", "__group").count())
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `size` rows
    rows, _ = plan(histogram, size)
    ahead = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "__group", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__ahead"))
    own = F.row_number().over(Window.partitionBy("length", "__group").orderBy("doc_id", "start", "__nth", "ids_crc32"))
    ranked = pieces.withColumn("__rank", own - 1).join(counts, ["length", "__group"])
    ranked = ranked.select(*[c for c in pieces.columns if c not in ("__nth", "__group")], (F.col("__rank") + F.col("__ahead")).cast("long").alias("__rank"))
    return ranked.mapInArrow(_placed(rows), schema + ids + ", sequence_id long, offset long")
