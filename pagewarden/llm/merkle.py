"""A Merkle manifest of a dataset: a tree of hashes a group, a tree over the groups' roots, a proof a row.

The tree is cut into blocks of 2**BITS consecutive nodes. A block is one row with the ordered array of its
nodes; `sequence`, `transform`, `slice` and `aggregate` collapse it level by level to its root. Block roots
are the nodes of the next round, so a round divides the nodes by 2**BITS, and rounds end when every group
is down to one node. Proofs come back down the same tables: a block's own siblings are looked up in its
levels, and what lies above is joined once a block.

Places within a group come from a sort by ranges of (group, order), so a group that holds most rows is
dealt over many tasks; a task's first place in each group follows from counts, a row a task and group.
Only hashes and what is carried move; texts are read once.

H is the lowercase hex sha256 of its inputs concatenated. While a level has several nodes, each two
consecutive ones, a last odd one alone, become their H.

Cases: null values hash as `-`; a null group is a group of its own and comes first, so does a null id;
rows that repeat an id are leaves each, ordered by leaf; a group of one row has that leaf as its root, one group
has its root as the root; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: A block has 2**BITS nodes: a row of some 100 KB, whatever the input.
BITS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<hash:string,left:boolean>>"


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else bytes in UTF-8, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The hash of a row's fields; `instead` has other values for some."""
    return h(*[field(instead.get(c, F.col(c))) for c in FIELDS])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(g, ...) with pos, the place in g by `order` from 0, and n, the rows of g."""
    sort = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    placed = stage(placed, "placed")
    tasks = placed.groupBy("g", "task").agg(F.min("at").alias("first"), F.count("*").alias("has"))
    group = Window.partitionBy("g")
    tasks = stage(tasks.withColumn("before", F.sum("has").over(group.orderBy("task")) - F.col("has")).withColumn("n", F.sum("has").over(group)).drop("has"), "tasks")
    return placed.join(tasks, ["g", "task"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("task", "at", "first", "before")


def _up(nodes: Column) -> Column:
    """The level above."""
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(2)), lambda i: F.sha2(F.array_join(F.slice(nodes, i, F.lit(2)), ""), 256))


def _levels(nodes: Column, steps: Column) -> Column:
    """The nodes, then `steps` levels above them."""
    kind = "array<array<string>>"
    more = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(more, F.array(nodes).cast(kind), lambda done, _: F.concat(done, F.array(_up(F.element_at(done, F.lit(-1))))).cast(kind))


def blocks(nodes: DataFrame, carry: list[str], bits: int) -> DataFrame:
    """Staged blocks of nodes(g, pos, n, node, *carry): g, block, above (nodes of g in the next round), rows, levels."""
    size = 1 << bits
    # levels until one node is left, or a block is one
    steps = F.when(F.col("n") > size, F.lit(bits)).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int")
    cut = nodes.withColumn("block", F.shiftright("pos", bits)).withColumn("above", F.ceil(F.col("n") / size).cast("long"))
    held = cut.groupBy("g", "block").agg(F.max("above").alias("above"), F.max(steps).alias("steps"), F.sort_array(F.collect_list(F.struct("pos", "node", *carry))).alias("rows"))
    return stage(held.withColumn("levels", _levels(F.col("rows.node"), F.col("steps"))), "blocks")


def _root() -> Column:
    return F.element_at(F.element_at("levels", F.lit(-1)), F.lit(1))


def forest(nodes: DataFrame, carry: list[str], bits: int) -> list[DataFrame]:
    """Blocks of all rounds; the last has a block a group, whose root is the group's."""
    rounds = [blocks(nodes, carry, bits)]
    while (rounds[-1].agg(F.max("above").alias("n")).first()["n"] or 0) > 1:
        rounds.append(blocks(rounds[-1].select("g", F.col("block").alias("pos"), F.col("above").alias("n"), _root().alias("node")), [], bits))
    return rounds


def proofs(rounds: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """g, node, pos, *carry and proof of every node of the first round. tops(g, proof, ...): what lies above each group."""
    keep = [c for c in tops.columns if c not in ("g", "proof")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for k, part in reversed([*enumerate(rounds)]):
        own = F.transform(
            "rows",
            lambda row, i: F.struct(
                row.alias("row"),
                F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), lambda level, up: F.struct(F.get(level, F.call_function("shiftright", i, up).bitwiseXOR(F.lit(1))).alias("hash"), (F.call_function("shiftright", i, up).bitwiseAND(F.lit(1)) == 1).alias("left"))).alias("near"),
            ),
        )
        each = part.select("g", "block", own.alias("own")).join(above, ["g", "block"]).select("g", *keep, F.col("proof").alias("far"), F.explode("own").alias("x"))
        out = each.select("g", *keep, "x.row.*", F.concat(F.col("x.near").cast(PROOF), "far").alias("proof"))
        above = stage(out.withColumnRenamed("pos", "block").drop("node"), "proofs") if k else out
    return above


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def step(x, s):
        beside = F.coalesce(s["hash"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(beside, x)).otherwise(F.concat(x, beside)), 256)

    return F.aggregate(proof, start, step)


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """order, leaf, *carry, subroot, root and proof: siblings from the leaf up, null where a node has none, and whether they stand left.

    carry: further columns, computed from docs."""
    carried = [order, *(carry or {})]
    # "" for a null group sorts before "=" and a name
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stage(docs.select(g.alias("g"), order, leaf().alias("node"), *[v.alias(k) for k, v in (carry or {}).items()]), "leaves")
    trees = forest(ranked(leaves, [order, "node"]), carried, bits)
    subroots = trees[-1].select("g", _root().alias("node"))
    crown = forest(ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), ["name"]), ["name"], bits)
    root = crown[-1].select("g", F.array().cast(PROOF).alias("proof"), _root().alias("root"))
    tops = proofs(crown, root, ["name"]).select(F.col("name").alias("g"), "proof", F.col("node").alias("subroot"), "root")
    return proofs(trees, stage(tops, "tops"), carried).select(order, F.col("node").alias("leaf"), *(carry or {}), "subroot", "root", "proof")


def tampered() -> Column:
    """The leaf with 1 added to n_chars where 7 divides crc32 of the id; null elsewhere."""
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    return F.when((F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull(), leaf(n_chars=more))


def verified(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The manifest of documents, each tampered row folded with the original's siblings."""
    out = manifest(docs, carry={"changed": tampered()}, bits=bits)
    out = out.withColumn("proof_sha256", F.sha2(F.array_join(F.col("proof.hash"), ""), 256))
    out = out.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("changed", "proof")
