"""Near-duplicates by MinHash with odd sketches, settled on full shingle sets.

A document's set holds the hashes of its distinct w-word shingles. Equal sets are one class from the
start: its smallest id stands for it. Representatives get BANDS bands of ROWS MinHash values; equal
bands make them candidates. At Jaccard similarity s a pair shares a band with probability
1 - (1 - s^ROWS)^BANDS: at 0.8 all but 3e-6 of the pairs, more above.

Candidates are not paired off. First a bucket's smallest member is its centre, and every other
member a candidate of that centre: as many pairs as rows. The odd sketch of a document, the parity
bitmap of its MinHash samples, decides which of them to verify: the population count of the XOR of two
sketches estimates their similarity, precisely where it is high. Pairs whose estimate is far below the
threshold go; the margin MARGIN is over four standard deviations. Of a document's remaining centres the
most similar is verified on the full sets, and verified links give components. Then buckets that
still hold several components are compared in full: by sketches, block against block, which joins
the members with a plausible partner in another component to clusters, and within clusters by their
sets. What comes back from a block is a forest at most, never its pairs. So every link between components that the bands reveal is found or refuted.

Cases: text that is null or without words has the empty set, linked with nothing; with fewer words
than a shingle, the whole sequence is the one shingle; rows that repeat a doc_id with other text are
one node, linked where any of them is; null ids take no part and come back without component; very long texts are
taken whole; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, giving_back, slices, stage

BANDS, ROWS = 24, 4
#: MinHash values, of which the bands take the first and the sketch all.
SAMPLES = 128
SKETCH_BITS = 1024
#: How far below the threshold an estimate may be for the pair still to be verified: at similarity 0.8 the sketches reject 6.5e-8 of the pairs.
MARGIN = 0.22
#: Members of a bucket, and shingles of a cluster's documents, that make a block and are compared at once with another.
SKETCH_BLOCK, SET_BLOCK = 512, 200_000
#: Rows that a Python worker gets at once: texts, pairs with sets, pairs of sketch blocks and of set blocks.
TEXT_ROWS, PAIR_ROWS, BLOCK_ROWS, SET_BLOCK_ROWS = 2000, 400, 100, 8
KEPT_WORDS = 100_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240501).integers(1, 1 << 63, size=(2, SAMPLES), dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, of which the latest are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text. Words are lower-cased in A-Z only."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters, and white space as in the contract
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=n)
    if n < width:
        width = n
    out = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        out = _mixed(out * _GOLD + h[i : n - width + 1 + i])
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """The SAMPLES MinHash values of a set."""
    mul, add = _SEEDS[0][:, None], _SEEDS[1][:, None]
    best = None
    for at in range(0, len(sets), 2048):
        least = (sets[None, at : at + 2048] * mul + add).min(axis=1)
        best = least if best is None else np.minimum(best, least)
    return best


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = _mixed(out * _GOLD + sig[: BANDS * ROWS].reshape(BANDS, ROWS)[:, i])
    return out.view(np.int64)


def odd_sketch(sig: np.ndarray) -> bytes:
    """Parities of the buckets into which the samples (number of the hash, its value) fall."""
    places = _mixed(sig + np.arange(len(sig), dtype=np.uint64) * _GOLD) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits: 1 + n/(4k) ln(1 - 2z/n) for k samples and n bits."""
    n, k = SKETCH_BITS, SAMPLES
    return 1 + n / (4 * k) * np.log(np.maximum(1e-9, 1 - 2 * differing / n))


def most_differing(threshold: float) -> int:
    """Sketches that differ in more bits than this needn't be verified."""
    z = np.arange(SKETCH_BITS // 2)
    return int(z[estimate(z) >= threshold - MARGIN].max(initial=0))


def _sets(width: int):
    @giving_back
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [shingles(x, width) for x in batch.column("text").to_pylist()]
                sigs = [signature(s) if len(s) else None for s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
                        pa.array([None if s is None else bands(s) for s in sigs], pa.list_(pa.int64())),
                        pa.array([None if s is None else odd_sketch(s) for s in sigs], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "print", "bands", "sketch"],
                )

    return run


def _only_sets(width: int):
    @giving_back
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingles(x, width).tobytes() for x in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "set"])

    return run


def _differ(most: int):
    @giving_back
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u8").reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                z = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)
                keep = [i for i, n in enumerate(batch.schema.names) if not n.startswith("sketch_")]
                out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(z, pa.int64())], [*(batch.schema.names[i] for i in keep), "z"])
                yield out.filter(pa.array(z <= most))

    return run


def _verify(percent: int):
    @giving_back
    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs: documents are linked when
    100 * common >= percent * union of their shingle sets, and components are those of the links."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stage(source.mapInArrow(_sets(width), "doc_id bigint, n_shingles bigint, print binary, bands array<bigint>, sketch binary"), "signatures", TEXT_ROWS)
    classes = stage(rows.filter("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first(F.struct("sketch", F.col("n_shingles").alias("size"), "bands")).alias("f")).select("print", "rep", "n", "f.*"), "classes")
    buckets = classes.select("rep", F.explode("bands").alias("key"))  # a band's number is in its hash
    shared = stage(buckets.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = stage(attach(buckets, shared, ["key"], "n", ["rep"]).select("rep", "key", "centre", "n"), "members")
    sketches = classes.select("rep", "sketch", "size")

    most = most_differing(percent / 100)
    pairs = members.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    near = _plausible(stage(pairs, "pairs"), sketches, most, percent)
    chosen = stage(near.groupBy("b").agg(F.min(F.struct("z", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "chosen")
    links = stage(_verified(chosen, source, width, percent), "links", PAIR_ROWS).filter("linked").select("a", "b")
    found = components(links)
    more = _links_between(members, near, found, sketches, source, most, width, percent)
    found = components(links.unionByName(more))
    labelled = stage(classes.select("print", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("print", "n", F.coalesce("component", "rep").alias("component_id")), "membership")
    full = rows.select("doc_id", "n_shingles", "print")
    linked = attach(full.filter("print IS NOT NULL AND doc_id IS NOT NULL"), labelled, ["print"], "n", ["doc_id"]).select("doc_id", "n_shingles", "component_id")
    alone = full.filter("print IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _with_both(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """pairs(a, b) with the columns of facts(rep, ...) for both ends; a may be hot, b has few pairs."""
    named = lambda end: facts.select(F.col("rep").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    counts = stage(pairs.groupBy("a").agg(F.count("*").alias("_w")), "counts")
    return attach(pairs.join(named("b"), "b"), named("a").join(counts.select("a"), "a", "left_semi"), ["a"], "_w", ["b"], weights=counts)


def _plausible(pairs: DataFrame, sketches: DataFrame, most: int, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow the threshold, with the number of differing bits."""
    met = _with_both(pairs, sketches, ["sketch", "size"])
    met = met.filter((100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))).drop("size_a", "size_b")
    return stage(met.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_differ(most), "a bigint, b bigint, z bigint"), "plausible")


def _full_sets(reps: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """rep, set for the documents that reps names, made anew from their texts."""
    texts = source.join(reps.distinct(), source["doc_id"] == F.col("rep"), "left_semi")
    return stage(texts.mapInArrow(_only_sets(width), "doc_id bigint, set binary").withColumnRenamed("doc_id", "rep"), "sets", TEXT_ROWS)


def _verified(pairs: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs with `linked`, by the full sets."""
    sets = _full_sets(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))), source, width)
    return _with_both(pairs, sets, ["set"]).select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a bigint, b bigint, linked boolean")


def _links_between(members: DataFrame, near: DataFrame, found: DataFrame, sketches: DataFrame, source: DataFrame, most: int, width: int, percent: int) -> DataFrame:
    """Links for any two components that have linked members in one bucket.

    All members of a bucket that holds several components are compared by sketch, block by block. Returned
    is not every plausible pair, but a forest that connects the members with a plausible partner in
    another component: its trees are clusters, outside of which nothing can be linked. The members of a
    cluster are compared by sketch and full set, block by block again, and links that connect
    components come back, a forest at most. A bucket of two is settled by the centre's pair."""
    known = found.withColumnRenamed("node", "rep")
    labels = stage(members.select("rep").distinct().join(known, "rep", "left").join(sketches, "rep").select("rep", F.coalesce("component", "rep").alias("component"), "sketch", "size"), "labels")
    of = labels.select("rep", "component")
    marked = stage(members.filter("n > 2").select("rep", "key").join(of, "rep"), "marked")
    mixed = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high")
    mixed = stage(mixed.select("key", "n"), "mixed")
    rest = attach(marked.select("key", "rep"), mixed, ["key"], "n", ["rep"]).join(labels, "rep")
    rest = rest.withColumn("blocks", F.ceil(F.col("n") / SKETCH_BLOCK).cast("int"))
    forest = _block_pairs(rest, ["key"], F.struct("rep", "component", "size", "sketch")).mapInArrow(_plausible_blocks(most, percent), "a bigint, b bigint").distinct()
    ends = [of.select(F.col("rep").alias(e), F.col("component").alias(f"c{e}")) for e in ("a", "b")]
    stars = near.select("a", "b").join(ends[0], "a").join(ends[1], "b").filter("ca <> cb").select("a", "b")
    clusters = components(stage(forest.unionByName(stars), "plausible", BLOCK_ROWS)).withColumnsRenamed({"node": "rep", "component": "cluster"})
    sized = stage(clusters.join(labels, "rep"), "clusters")
    blocks = sized.groupBy("cluster").agg(F.ceil(F.sum("size") / SET_BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    rows = attach(sized, stage(blocks, "blocks"), ["cluster"], "n", ["rep"]).join(_full_sets(clusters.select("rep"), source, width), "rep")
    met = _block_pairs(rows, ["cluster"], F.struct("rep", "component", "size", "sketch", "set"))
    return stage(met.mapInArrow(_link_blocks(most, percent), "a bigint, b bigint"), "links", SET_BLOCK_ROWS)


def _block_pairs(rows: DataFrame, keys: list[str], item) -> DataFrame:
    """left, right: every two blocks of a key's rows, and each block with itself. `blocks` says how many a key
    has. The second block's number is part of the join's key, so the pairs of a large key are dealt over
    as many tasks as it has blocks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    packed = stage(rows.groupBy(*keys, "blocks", "block").agg(F.collect_list(item).alias("left")), "packed")
    first = packed.select(*keys, F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block"), "left")
    return first.join(packed.select(*keys, "block", F.col("left").alias("right")), [*keys, "block"]).select("left", "right")


def _sides(batch, fields: tuple[str, ...]):
    """For left and right: where each row's items end, their sketches, and their fields."""
    for name in ("left", "right"):
        column = batch.column(name)
        flat = column.flatten()
        ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
        sketch = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), dtype="<u8").reshape(len(flat), -1)
        yield ends, sketch, [flat.field(c).to_numpy(zero_copy_only=False) for c in fields]


def _could_link(c, n, s, c2, n2, s2, most: int, percent: int) -> np.ndarray:
    """Which pairs are in different components and allow the threshold by size and sketch."""
    ok = c[:, None] != c2[None, :]
    ok &= 100 * np.minimum(n[:, None], n2[None, :]) >= percent * np.maximum(n[:, None], n2[None, :])
    if ok.any():
        z = np.zeros(ok.shape, dtype=np.int64)
        for w in range(s.shape[1]):
            z += np.bitwise_count(s[:, w][:, None] ^ s2[:, w][None, :])
        ok &= z <= most
    return ok


def _plausible_blocks(most: int, percent: int):
    top = np.iinfo(np.int64).max

    @giving_back
    def run(batches):
        for batch in batches:
            out = []
            (e, s, (r, c, n)), (e2, s2, (r2, c2, n2)) = _sides(batch, ("rep", "component", "size"))
            for i in range(batch.num_rows):
                x, y = slice(e[i], e[i + 1]), slice(e2[i], e2[i + 1])
                ok = _could_link(c[x], n[x], s[x], c2[y], n2[y], s2[y], most, percent)
                if not ok.any():
                    continue
                a, b = r[x].copy(), r2[y].copy()  # labels: the least id of those connected
                while True:
                    new = np.minimum(a, np.where(ok, b[None, :], top).min(axis=1))
                    far = np.minimum(b, np.where(ok, new[:, None], top).min(axis=0))
                    if (new == a).all() and (far == b).all():
                        break
                    a, b = new, far
                for ids, labels in ((r[x], a), (r2[y], b)):
                    moved = ids != labels
                    out.append(np.stack((labels[moved], ids[moved]), axis=1))
            if out:
                rows = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, j]), pa.int64()) for j in range(2)], ["a", "b"])

    return run


def _link_blocks(most: int, percent: int):
    def links(ok, left, right, components_left, components_right, ids_left, ids_right):
        """Links that connect components not yet connected within these two blocks."""
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        sets = [[np.frombuffer(x, dtype=np.uint64) for x in side] for side in (left, right)]
        every, index = np.unique(np.concatenate(sets[0] + sets[1]), return_inverse=True)
        ends = np.cumsum([len(x) for side in sets for x in side])
        starts = np.concatenate(([0], ends[:-1]))
        mark = np.zeros(len(every), dtype=bool)
        m = len(sets[0])
        for i in np.flatnonzero(ok.any(axis=1)):
            mine = index[starts[i] : ends[i]]
            mark[mine] = True
            for j in np.flatnonzero(ok[i]):
                a, b = find(int(components_left[i])), find(int(components_right[j]))
                if a != b:
                    common = int(np.count_nonzero(mark[index[starts[m + j] : ends[m + j]]]))
                    if 100 * common >= percent * (len(sets[0][i]) + len(sets[1][j]) - common):
                        root[max(a, b)] = min(a, b)
                        yield int(ids_left[i]), int(ids_right[j])
            mark[mine] = False

    @giving_back
    def run(batches):
        for batch in batches:
            (e, s, (r, c, n)), (e2, s2, (r2, c2, n2)) = _sides(batch, ("rep", "component", "size"))
            set_l, set_r = (batch.column(k).flatten().field("set") for k in ("left", "right"))
            got = []
            for i in range(batch.num_rows):
                x, y = slice(e[i], e[i + 1]), slice(e2[i], e2[i + 1])
                ok = _could_link(c[x], n[x], s[x], c2[y], n2[y], s2[y], most, percent)
                if ok.any():
                    some = [k[z.start : z.stop].to_pylist() for k, z in ((set_l, x), (set_r, y))]
                    got += links(ok, *some, c[x], c2[y], r[x], r2[y])
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(2)], ["a", "b"])

    return run
