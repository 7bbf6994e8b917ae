"""A training corpus from raw documents: five stages, each an operator of taintloom.llm over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintloom.llm.common import forget, written
from taintloom.llm.packing import TOKENIZER, pack
from taintloom.llm.pii import mask_pii
from taintloom.llm.quality import score_quality
from taintloom.llm.simhash import keep_one
from taintloom.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_size(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is scored as an empty one; rows with repeated or null ids are judged one by one; long texts count whole.
    An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels).filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the first by id, then by a hash of its text.

    Null and empty texts are near-duplicates of each other; null ids come last; different texts under one id count
    each for themselves; of equal rows one stays. An empty table stays empty.
    """
    return keep_one(docs).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that occur elsewhere go from the texts; bytes of a character cut in two go with it.

    Documents without repeats pass as they are, null texts too; a document of which nothing is left stays, empty.
    """
    return _with_size(suffix_dedup(docs, with_text=True).withColumn("text", F.col("kept")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets.

    Null texts stay null, rows without personal data stay as they are, repeated ones too. An empty table stays empty.
    """
    return _with_size(mask_pii(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in the training sequences.

    A null or empty text is one piece, its end id; rows with equal or null ids are documents of their own; long texts
    are cut into pieces. An empty table has no pieces.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The learned and fixpoint stages have no SQL form; tests hold run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next; a table that has been read goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir))
        forget(docs)
        docs = kept
    # packing has written its pieces when it returns
    out = STAGES[-1][1](spark, docs, sf_dir)
    forget(docs)
    return out
