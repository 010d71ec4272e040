"""Substring search by an inverted index of trigrams.

Distinct texts get ids in sorted order and lie in shelves of SEGMENT * SHELF of them. For each trigram of a text
in lower case and each segment of ids there is one posting list: the ids as distances from the segment's first, ascending
16-bit numbers, so a list has SEGMENT entries at most however common its trigram is. Postings are kept in
order of trigram, so a search reads the row groups of its own trigrams.

A search takes the RAREST trigrams of the needle, intersects their lists a segment at a time, reads the shelves
in which something is left, and compares only those texts with the needle, by `ilike`.

Needles are patterns as `ilike` has them: % and _ are wildcards. One without three fixed characters
in a row has no trigram and is compared with all texts.

Cases: null texts aren't found; texts under three characters have no trigrams, and no needle with one can
match them; an empty table gives an empty index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Ids of a posting list (of 16 bits), segments of a shelf, trigrams that a search reads.
SEGMENT = 1 << 15
SHELF = 64
RAREST = 4


def grams(needle: str) -> list[str]:
    """The trigrams that every text matching a needle has."""
    fixed = re.split(r"\\.?|[%_]", needle.lower())
    return sorted({p[i : i + 3] for p in fixed for i in range(len(p) - 2)})


def numbered(texts: DataFrame, column: str = "text") -> DataFrame:
    """text, id, segment, shelf of the distinct texts. Ids are ascending, with gaps; write the table before anything reads it twice."""
    once = texts.select(F.col(column).alias("text")).filter("text IS NOT NULL").distinct()
    placed = once.repartitionByRange("text").sortWithinPartitions("text").withColumn("id", F.monotonically_increasing_id())
    segment = F.floor(F.col("id") / SEGMENT)
    return placed.withColumn("segment", segment).withColumn("shelf", F.floor(segment / SHELF))


def postings(rows: DataFrame) -> DataFrame:
    """gram, segment, n, near: the posting lists of numbered rows, in order of gram."""
    low = F.lower("text")
    cut = F.expr("transform(sequence(1, length(low) - 2), i -> substring(low, i, 3))")
    each = rows.select("segment", (F.col("id") - F.col("segment") * SEGMENT).cast("smallint").alias("near"), low.alias("low")).filter("length(low) > 2")
    each = each.select("segment", "near", F.explode(F.array_distinct(cut)).alias("gram"))
    lists = each.groupBy("gram", "segment").agg(F.sort_array(F.collect_list("near")).alias("near"))
    return lists.select("gram", "segment", F.size("near").alias("n"), "near").repartitionByRange("gram", "segment").sortWithinPartitions("gram", "segment")


def candidates(lists: DataFrame, needle: str) -> DataFrame | None:
    """segment, ids of the texts that have the needle's rarest trigrams; None for a needle without any."""
    wanted = grams(needle)
    if not wanted:
        return None
    sizes = {r["gram"]: r["n"] for r in lists.filter(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # the needle's trigrams
    if len(sizes) < len(wanted):
        return lists.sparkSession.createDataFrame([], "segment bigint, ids array<bigint>")
    rarest = sorted(wanted, key=lambda g: (sizes[g], g))[:RAREST]
    met = lists.filter(F.col("gram").isin(rarest)).groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("n", "near"))).alias("all")).filter(F.size("all") == len(rarest))
    common = F.aggregate(F.slice("all", 2, RAREST), F.element_at("all", 1)["near"], lambda have, more: F.array_intersect(have, more["near"]))
    met = met.select("segment", common.alias("near")).filter(F.size("near") > 0)
    return met.select("segment", F.transform("near", lambda x: F.col("segment") * SEGMENT + x).alias("ids"))


def search(rows: DataFrame, lists: DataFrame, needle: str) -> DataFrame:
    """text of the numbered rows that match a needle. rows should be partitioned by shelf."""
    met, found = candidates(lists, needle), F.col("text").ilike(f"%{needle}%")
    if met is None:
        return rows.filter(found).select("text")
    met = stage(met, "met")
    shelves = [r["shelf"] for r in met.select(F.floor(F.col("segment") / SHELF).alias("shelf")).distinct().collect()]  # of SEGMENT * SHELF texts each
    ids = met.select(F.explode("ids").alias("id"))
    return rows.filter(F.col("shelf").isin(shelves)).join(ids, "id", "left_semi").filter(found).select("text")
