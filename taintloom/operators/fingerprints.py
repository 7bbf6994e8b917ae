"""Fingerprints of annotated functions: hashes, differences, coverage."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintloom.functions.domains import GROUP, TRANSITIONS
from taintloom.functions.lattice import lookup


def annotation_hash(version: str, qualname: Column, names: Column, attributes: Column | None = None) -> Column:
    """16 hex digits over interpreter version, name, sorted decorators and attributes; the file does not count."""
    attributes = F.lit("") if attributes is None else attributes
    return F.substring(F.sha2(F.concat_ws("|", F.lit(version), qualname, F.array_join(F.array_sort(names), ","), attributes), 256), 1, 16)


def source_hash(version: str, path: Column, qualname: Column, dump: Column) -> Column:
    """16 hex digits over interpreter version, path, name and syntax tree."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(version), path, qualname, dump), 256), 1, 16)


def diff(baseline: DataFrame, current: DataFrame, same_version: bool = True, since: str | None = None) -> DataFrame:
    """ADDED, REMOVED and MODIFIED names. Another interpreter version modifies all common ones; `since` drops
    entries last changed before it, or never. A name counts once: its last entry."""
    def last(df: DataFrame, as_: str) -> DataFrame:
        return df.groupBy("qualname").agg(F.max_by(F.struct("annotation_hash", "last_changed"), "ordinal").alias(as_))

    both = last(baseline, "b").join(last(current, "c"), "qualname", "full")
    change = (
        F.when(F.col("b").isNull(), "ADDED")
        .when(F.col("c").isNull(), "REMOVED")
        .when((F.col("b.annotation_hash") != F.col("c.annotation_hash")) | F.lit(not same_version), "MODIFIED")
    )
    out = both.select("qualname", change.alias("change"), F.coalesce("c.last_changed", "b.last_changed").alias("last_changed")).filter("change is not null")
    return out if since is None else out.filter(F.col("last_changed") >= since)


def coverage(functions: DataFrame, annotated: DataFrame) -> DataFrame:
    """One row: annotated and total functions, and of them those of tier 1."""
    f = functions.join(annotated.select("qualname").distinct().withColumn("__yes", F.lit(True)), "qualname", "left")
    yes, one = F.col("__yes").isNotNull(), F.col("tier") == 1
    return f.agg(
        F.count_if(yes).alias("annotated"), F.count("*").alias("total"), F.round(F.coalesce(F.count_if(yes) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("ratio"),
        F.count_if(yes & one).alias("tier1_annotated"), F.count_if(one).alias("tier1_total"),
    )


def artefact_class(annotations: DataFrame) -> DataFrame:
    """policy for functions with a decorator of groups 1 to 4, else enforcement; and the first transition."""
    g, t = lookup(GROUP, "name"), lookup(TRANSITIONS, "name")
    return annotations.groupBy("qualname").agg(
        F.when(F.max(F.coalesce(g.between(1, 4), F.lit(False))), "policy").otherwise("enforcement").alias("artefact_class"),
        F.min_by(t, F.when(t.isNotNull(), F.col("pos"))).alias("boundary_transition"),
    )


def _in_order(batches):
    """The hash of the records that come, in their order, and their number."""
    whole, n = hashlib.sha256(), 0
    for batch in batches:
        for record in batch.column(0):
            whole.update(record.as_py().encode())
        n += len(batch)
    yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest()]), pa.array([n], pa.int64())], ["hash", "n"])


def input_hash(files: DataFrame, path: str, content: str) -> DataFrame:
    """One hash over all files: of the sorted records (path, NUL, hash of the content), a line each.

    Contents are hashed where they are. The hash of a sequence has to be taken in order, so records of about a
    hundred bytes a file pass one task; they are sorted there with spilling and streamed, never held together.
    """
    rows = files.select(F.concat(F.col(path), F.lit("\0"), F.sha2(F.col(content).cast("binary"), 256), F.lit("\n")).alias("record")).distinct()
    one = rows.repartition(1).sortWithinPartitions("record").mapInArrow(_in_order, "hash string, n long")
    none = hashlib.sha256().hexdigest()
    return one.agg(F.concat(F.lit("sha256:"), F.coalesce(F.max_by("hash", "n"), F.lit(none))).alias("input_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def blanket_files(functions: DataFrame, decorated: DataFrame) -> DataFrame:
    """Files of five functions or more, over 0.8 of them by module default; and files without decorators whose first
    function is trusted."""
    d = decorated.select("file_path").distinct().withColumn("__d", F.lit(True))
    per = functions.groupBy("file_path").agg(
        F.count("*").alias("n"), F.count_if(F.col("taint_source") == "module_default").alias("n_default"), F.min_by("taint", "pos").alias("first_taint"),
    ).join(d, "file_path", "left")
    return per.select(
        "file_path", ((F.col("n") >= 5) & (F.col("n_default") / F.col("n") > 0.8)).alias("blanket"), (F.col("__d").isNull() & (F.col("n_default") > 0) & F.col("first_taint").isin("INTEGRAL", "ASSURED")).alias("undecorated"),
    ).filter("blanket or undecorated")


def decorator_gate(functions: DataFrame, annotated: DataFrame, tiers: tuple[int, ...] = (1, 4), least: float = 80.0) -> DataFrame:
    """For each of these tiers the share of decorated functions, in percent, and whether it reaches the least."""
    f = functions.filter(F.col("tier").isin(*tiers)).join(annotated.select("qualname").distinct().withColumn("__yes", F.lit(True)), "qualname", "left")
    share = F.round(F.count_if(F.col("__yes").isNotNull()) * 100.0 / F.count("*"), 3)
    return f.groupBy("tier").agg(share.alias("pct")).withColumn("met", F.col("pct") >= least)
