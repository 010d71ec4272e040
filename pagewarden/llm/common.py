"""What the corpus operators share: the scratch folder, staged tables, joins that
survive hot keys, and connected components."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import staging
from ..staging import fresh  # noqa: F401  also for the operators

#: A key is hot when it holds more than this part of all rows, so at most so many keys are hot.
HOT_KEYS = 1000
#: Keys with fewer rows than this are never hot.
HOT_FLOOR = 50
#: White space as the corpus contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read back. rows: how many go to a Python worker at once, where rows are large."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    before = conf.get(key, None) if rows else None
    try:
        if rows:
            conf.set(key, str(rows))
        return staging.stage(df, name)
    finally:
        if rows:
            conf.set(key, before) if before else conf.unset(key)


def slices(batch: pa.RecordBatch, column: str, size: int = 500_000):
    """A batch in pieces of about `size` bytes of a text column, or items of a list column, and a row at least:
    what a worker holds at once then doesn't depend on how Spark cuts its batches."""
    values = batch.column(column)
    length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield batch.slice(at, to - at)
        at = to


def giving_back(run):
    """run(batches) for a Python worker; when it ends, what the worker has freed goes back to the machine. Workers outlive
    their tasks, and Arrow and the C library would keep it, in each worker, beside whatever the executor does next."""

    @functools.wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return out


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, spread: list[str], how: str = "inner", weights: DataFrame | None = None) -> DataFrame:
    """rows joined with groups, which has one row for each key. weights (groups itself, unless given) has
    the number of each key's rows in the column `weight`; it is read twice, so it should be staged.

    A hot key's rows are dealt over several tasks by a hash of the columns `spread`, and its one
    row of groups is copied to each of them. The broadcast table holds only hot keys: at most HOT_KEYS,
    as each has over 1/HOT_KEYS of all rows."""
    weights = groups if weights is None else weights
    limit = F.greatest(F.lit(HOT_FLOOR), F.ceil(F.sum(weight) / HOT_KEYS)).cast("long")
    bound = weights.agg(limit.alias("n")).first()["n"] or HOT_FLOOR
    hot = F.broadcast(weights.filter(F.col(weight) > bound).select(*keys, F.ceil(F.col(weight) / bound).cast("int").alias("_n")))
    left = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_n"))).cast("int")).drop("_n")
    right = groups.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component for every node of edges(a, b): the smallest node that can be reached.

    Each round every node takes the least label among its neighbours and itself, then the label of
    its label, so paths halve. It ends when no label changes. Rows with equal ends are allowed."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    degree = stage(both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("w"), F.min("b").alias("near")), "degree")
    labels = stage(degree.select(F.col("b").alias("node"), F.least("b", "near").alias("label"), "w"), "labels")
    for _ in range(rounds):
        seen = attach(both, labels.select(F.col("node").alias("b"), "label", "w"), ["b"], "w", ["a"])
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("best"))
        new = stage(labels.join(least, "node", "left").select("node", F.least("label", "best").alias("label"), "w", F.col("label").alias("old")), "labels")
        size = stage(new.groupBy(F.col("label").alias("at")).agg(F.count("*").alias("n")), "sizes")
        goal = size.join(new.select(F.col("node").alias("at"), F.col("label").alias("far")), "at", "left")
        new = stage(attach(new.withColumnRenamed("label", "at"), stage(goal, "goals"), ["at"], "n", ["node"], "left").select("node", F.least("at", F.coalesce("far", "at")).alias("label"), "w", "old"), "labels")
        moved = new.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = new.drop("old")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", F.col("label").alias("component"))


def words_of(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
