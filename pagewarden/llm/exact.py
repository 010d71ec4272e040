"""Exact de-duplication in two Bloom passes.

Pass 1 marks, in a filter of two-bit counters, every hash bucket that was hit more than once.
Pass 2 tests each row against that filter. A row of which some bucket was hit once only can't have
an equal, so it goes straight to the result; just the possibly repeated rows shuffle, and grouping
by the full SHA-256 settles which of them are. False positives cost a shuffle of 40 bytes, never a
wrong result.

The filter grows with the rows, BITS_A_ROW for each. Beyond 2**MAX_BITS it is cut into parts by bits of
the digest: digests are written under a folder for each part, without a shuffle, and each part has its
own two passes over its own folder. So all digests are read as often as with one part, a broadcast
holds 32 MB whatever the input, and the rate of false positives stays as it is.

Cases: null text counts as empty; all empty texts are equal; rows that repeat a doc_id are all
returned, each as a member of its group; a null doc_id is kept and never chosen unless its group
has no other; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, attach, fresh, stage

#: Bits of the filter for each row, and the most bits of one part: 2**28 buckets, 32 MB.
BITS_A_ROW = 16
MAX_BITS = 28
SEGMENT = 16
FLUSH = 2_000_000


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _places(digests: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets of each digest, by its first and second eight bytes."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)
    shift = np.uint64(64 - bits)
    return (raw[:, 0] >> shift).astype(np.int64), (raw[:, 1] >> shift).astype(np.int64)


def _count_hits(bits: int):
    def run(batches):
        def flush():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            for many in (False, True):
                part = at[(n > 1) == many]
                cuts = np.flatnonzero(np.diff(part >> SEGMENT)) + 1
                for piece in np.split(part, cuts) if len(part) else ():
                    yield int(piece[0] >> SEGMENT), many, (piece & 0xFFFF).astype("<u2").tobytes()

        def table(rows):
            return pa.RecordBatch.from_pydict({"segment": pa.array([r[0] for r in rows], pa.int32()), "many": pa.array([r[1] for r in rows], pa.bool_()), "at": pa.array([r[2] for r in rows], pa.binary())})

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                a, b = _places(batch.column(0), bits)
                held.append(a)
                held.append(b[b != a])
                n += 2 * batch.num_rows
            if n > FLUSH:
                yield table(list(flush()))
                held, n = [], 0
        if n:
            yield table(list(flush()))

    return run


def _merge(key, frame):
    """The buckets of one segment that were hit more than once over all tasks."""
    import pandas as pd

    hits = np.zeros(1 << SEGMENT, dtype=np.int64)
    for many, at in zip(frame["many"], frame["at"]):
        hits[np.frombuffer(at, dtype="<u2")] += 2 if many else 1
    again = np.flatnonzero(hits > 1).astype("<u2")
    return pd.DataFrame({"segment": [key[0]], "at": [again.tobytes()]})


def _test(bits: int, filter_bytes):
    def run(batches):
        marks = np.frombuffer(filter_bytes.value, dtype=np.uint8)

        def hit(at):
            return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1

        for batch in batches:
            if batch.num_rows:
                a, b = _places(batch.column("digest"), bits)
                yield batch.append_column("maybe", pa.array((hit(a) & hit(b)).astype(bool)))

    return run


def _marks(digests: DataFrame, bits: int) -> bytes:
    """The filter of one part: a bit for each bucket hit more than once. The driver gets two bytes for each such
    bucket, segment by segment, and a part has at most 2**bits / BITS_A_ROW rows."""
    hits = digests.select("digest").mapInArrow(_count_hits(bits), "segment int, many boolean, at binary")
    again = hits.groupBy("segment").applyInPandas(_merge, "segment int, at binary")
    marks = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in again.toLocalIterator():
        at = (row["segment"] << SEGMENT) + np.frombuffer(row["at"], dtype="<u2").astype(np.int64)
        np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return marks.tobytes()


def possibly_repeated(digests: DataFrame, rows: int, max_bits: int | None = None) -> DataFrame:
    """digests(doc_id, digest) with `maybe`: false only where no other row can have the digest."""
    spark, most = digests.sparkSession, MAX_BITS if max_bits is None else max_bits
    need = max(SEGMENT, int(np.ceil(np.log2(max(1, rows) * BITS_A_ROW))))
    bits, parts = min(most, need), 1 << max(0, need - most)
    if parts > 1:
        # bytes that the buckets don't use
        part = F.pmod(F.conv(F.hex(F.substring("digest", 17, 4)), 16, 10).cast("long"), F.lit(parts)).cast("int")
        digests.withColumn("part", part).write.partitionBy("part").parquet(path := fresh(spark, "parts"))
        digests = spark.read.schema("doc_id bigint, digest binary, part int").parquet(path)
    out = None
    for number in range(parts):
        mine = digests.filter(F.col("part") == number).drop("part") if parts > 1 else digests
        sent = spark.sparkContext.broadcast(_marks(mine, bits))
        tested = mine.mapInArrow(_test(bits, sent), "doc_id bigint, digest binary, maybe boolean")
        if parts > 1:  # one table, so that the plan doesn't grow with the parts
            tested.write.mode("append").parquet(done := path + "-tested")
        else:
            out = tested
    return out if parts == 1 else spark.read.schema("doc_id bigint, digest binary, maybe boolean").parquet(done)


def exact_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", max_bits: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    digests = stage(docs.select(F.col(id).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest")), "digests")
    tested = possibly_repeated(digests, digests.count(), max_bits)
    alone = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    maybe = stage(tested.filter("maybe").drop("maybe"), "maybe")
    groups = stage(maybe.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    met = attach(maybe, groups, ["digest"], "group_size", ["doc_id"]).select("doc_id", "keep_id", "group_size", "digest")
    out = alone.unionByName(met)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
