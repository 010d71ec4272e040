"""Duplicate pages: by a key, by content hash, and by simhash within a few bits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dialect import SPARK

#: Bits in which near-duplicates may differ, and blocks of a simhash: with three bits in six blocks, three stay equal.
DISTANCE, BLOCKS = 3, 6


def duplicates(rows: DataFrame, key: str, id: str = "page_id", partial: bool = True) -> DataFrame:
    """id, primary: every row after the first, by id, of those that share a key that isn't null."""
    # The first row of a key is an aggregate, so a hot key costs a row a task, not a window.
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(id).alias("primary"), F.count("*").alias("n")).filter("n > 1").select(key, "primary")
    return rows.join(first, key).filter(F.col(id) != F.col("primary")).select(id, "primary")


def simhashes(rows: DataFrame, text: str, id: str = "doc_id") -> DataFrame:
    """id, simhash over the tokens of a text, repeats counted; texts without tokens have none."""
    tokens = rows.select(id, F.explode(F.expr(tx.tokens(SPARK, text))).alias("token")).select(id, F.expr(SPARK.hash("token")).alias("h"))
    return tokens.groupBy(id).agg(F.expr(tx.simhash_sums(SPARK, "h")).alias("simhash"))


def near_pairs(hashes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, keep: tuple[str, ...] = ()) -> DataFrame:
    """a, b, distance for two different simhashes within `distance` bits: the hashes themselves, as rows
    with one hash are one class. Keys are the blocks that can stay equal, so each is long and selective.

    keep: columns that depend on the simhash alone, given as {name}_a and {name}_b."""
    width = tx.SIMHASH_BITS // blocks
    choices = list(combinations(range(blocks), blocks - distance))
    masks = [sum(((1 << width) - 1) << i * width for i in c) for c in choices]
    keys = F.array(*[F.struct(F.lit(n).alias("table"), F.col("simhash").bitwiseAND(mask).alias("part")) for n, mask in enumerate(masks)])
    one = hashes.filter("simhash <> 0").select("simhash", *keep).distinct().select("simhash", *keep, F.explode(keys).alias("key")).select("simhash", *keep, "key.*")
    side = lambda x: one.select(F.col("simhash").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in keep], "table", "part")
    # Spark measures a side before its keys are exploded and would broadcast it through the driver.
    met = side("a").hint("merge").join(side("b").hint("merge"), ["table", "part"]).filter("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # Of the tables in which a pair meets, the first gives it.
    first = F.coalesce(*[F.when(differ.bitwiseAND(mask) == 0, F.lit(n)) for n, mask in enumerate(masks)])
    return met.filter(F.bit_count(differ) <= distance).filter(first == F.col("table")).select("a", "b", F.bit_count(differ).alias("distance"), *[f"{c}_{x}" for c in keep for x in ("a", "b")])


def first_of_class(hashes: DataFrame, id: str = "doc_id") -> DataFrame:
    """simhash, its first id and number of rows."""
    return hashes.groupBy("simhash").agg(F.min(id).alias("first_id"), F.count("*").alias("rows"))


def numbered(rows: DataFrame, key: str, id: str, most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(id))).filter(F.col("place") <= most)
