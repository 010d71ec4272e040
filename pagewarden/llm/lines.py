"""Line de-duplication by a suffix array over line ids, built by distributed prefix doubling.

A document is the sequence of its lines that hold a word. Lines that occur once end every repeated
run, so only repeated lines take part. Each document is a row with the arrays of its lines; a suffix
begins at each. Ranks are places in the suffix array: a rank is the number of suffixes that sort before
the group which shares it. Doubling sorts the distinct pairs (rank by h lines here, rank h lines
further on) of the groups that are still open and gives each pair its place within its group, so that
ranks by 2h lines refine those by h. A group closes when it has one member or all its members end; the
rounds go on until every group is closed, and fewer suffixes take part in each.

The suffix array is then sorted in full (rank, document, line), and each suffix is compared with the one
before it: the array of longest common prefixes. A stretch of the suffix array in which that is m at
least is an interval whose suffixes share m lines. A run counts when it holds `min_words` words, so
m is the length of the shortest run of that size which starts, or ends, at a line; as a line has a word,
m is no more than `min_words`, and prefixes are compared so far. In each interval the first copy, by
document and line, stays; the others' lines are deleted. Longer runs are unions of these, because every part
of a later copy that has that size is a later copy too: what goes is the later copies of the maximal repeated runs.

Nothing of this needs a whole group in one task: sorts deal rows by range, a range hands what it
can't know (how its first group or interval began) to the driver as one row, and joins on hot ranks are salted.

Cases: null text stays null and empty text empty; lines without words stay unless no line with words
is left, then the text is empty; copies within a document count; rows that are equal are one
document and share its fate; rows that repeat a doc_id with other text are different documents; a null doc_id takes no part and comes back as it was; very long texts
and lines are taken whole; an empty table gives an empty result; other columns pass through, columns
named like the added ones are replaced."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, stage, words_of

MIN_WORDS = 10
ADDED = ("text_kept", "lines_deleted", "runs")


def _lines(docs: DataFrame) -> DataFrame:
    """doc, part (of rows that share an id), line (its place in the text), at (among lines with words), h1, h2, words."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.named_struct(F.lit("line"), i, F.lit("content"), x, F.lit("words"), words_of(x).cast("int")))
    # Hashed and split before the lines are dealt out: beside a generator it would be done again for each line.
    whole = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("part"), F.filter(lines, lambda x: x["words"] > 0).alias("lines"))
    rows = whole.select("doc", "part", F.posexplode("lines").alias("at", "x"))
    return rows.select("doc", "part", "x.line", "at", F.xxhash64("x.content").alias("h1"), F.xxhash64(F.lit(1), "x.content").alias("h2"), "x.words")


def _batch(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], list(types))


PLACED = {"r": pa.int64(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "before": pa.int64(), "first": pa.bool_(), "range": pa.int32(), "summary": pa.bool_()}


def _places(batches):
    """Rows r, a, b, n in the order of a range sort, with the n of earlier rows of their r in this range (`before`), and
    whether theirs is the range's first r. At last a summary: last r, first r, n of the last r, whether it is the first."""
    number, last, carried, first_r, in_first = TaskContext.get().partitionId(), None, 0, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        r, a, b, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if last is None:
            first_r = last = int(r[0])
        cum = np.cumsum(n) - n
        new = np.concatenate(([r[0] != last], r[1:] != r[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(r)), -1))
        before = np.where(start < 0, carried + cum, cum - cum[np.maximum(start, 0)])
        yield _batch({"r": r, "a": a, "b": b, "n": n, "before": before, "first": (start < 0) & in_first, "range": np.full(len(r), number), "summary": np.zeros(len(r), bool)}, PLACED)
        in_first = in_first and not new.any()
        last, carried = int(r[-1]), int(before[-1] + n[-1])
    if last is not None:
        yield _batch({"r": [last], "a": [first_r], "b": [None], "n": [carried], "before": [None], "first": [in_first], "range": [number], "summary": [True]}, PLACED)


def placed(groups: DataFrame) -> DataFrame:
    """groups(r, a, b, n) with rank: r plus the n of all groups of the same r that sort before by (a, b)."""
    spark = groups.sparkSession
    rows = stage(groups.select("r", "a", "b", "n").orderBy("r", "a", "b").mapInArrow(_places, "r bigint, a bigint, b bigint, n bigint, before bigint, first boolean, range int, summary boolean"), "placed")
    carry, last, held = [], None, 0
    for x in rows.filter("summary").select("range", F.col("r").alias("last"), F.col("a").alias("begin"), "n", "first").orderBy("range").collect():  # a row a task
        mine = held if x["begin"] == last else 0
        carry.append((x["range"], mine))
        last, held = x["last"], x["n"] + (mine if x["first"] else 0)
    carried = F.broadcast(spark.createDataFrame(carry, "range int, carried bigint"))
    return rows.filter("NOT summary").join(carried, "range", "left").select("r", "a", "b", "n", (F.col("r") + F.col("before") + F.when(F.col("first"), F.col("carried")).otherwise(0)).alias("rank"))


def _flat(batch: pa.RecordBatch, *names: str):
    """For each item of a batch's list columns: the number of its row, its place there, and its values; and where rows begin."""
    lengths = batch.column(names[0]).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - begin[owner], begin, [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in names]


def _ahead(owner: np.ndarray, at: np.ndarray, values: np.ndarray, h: int) -> np.ndarray:
    """What stands h lines further on, -1 where a line that isn't repeated, or the end, comes before."""
    out = np.full(len(values), -1, dtype=np.int64)
    if h < len(values):
        good = (owner[h:] == owner[:-h]) & (at[h:] - at[:-h] == h)
        out[:-h][good] = values[h:][good]
    return out


def _pairs(h: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                owner, k, _, (at, rank, is_open) = _flat(batch, "at", "rank", "open")
                ahead, mine = _ahead(owner, at, rank, h), np.flatnonzero(is_open)
                doc, part = (batch.column(c).to_numpy()[owner[mine]] for c in ("doc", "part"))
                types = dict.fromkeys(("doc", "part", "k", "r", "a"), pa.int64())
                yield _batch({"doc": doc, "part": part, "k": k[mine], "r": rank[mine], "a": ahead[mine]}, types)

    return run


def _updated(batches):
    """Documents with the new ranks of their open suffixes."""
    for batch in batches:
        if batch.num_rows:
            owner, _, begin, (rank, is_open) = _flat(batch, "rank", "open")
            rank, is_open = rank.copy(), np.zeros(len(rank), dtype=bool)
            news = batch.column("news")
            row = np.repeat(np.arange(batch.num_rows), news.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            new = news.flatten()
            to = begin[row] + new.field("k").to_numpy(zero_copy_only=False)
            rank[to], is_open[to] = new.field("rank").to_numpy(zero_copy_only=False), new.field("open").to_numpy(zero_copy_only=False)
            ends = pa.array(np.append(begin, len(rank)).astype(np.int32))
            fixed = [batch.column(c) for c in ("doc", "part", "at", "words", "id")]
            yield pa.RecordBatch.from_arrays([*fixed, pa.ListArray.from_arrays(ends, pa.array(rank, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(is_open))], ["doc", "part", "at", "words", "id", "rank", "open"])


DOCUMENT = "doc bigint, part bigint, at array<bigint>, words array<bigint>, id array<bigint>, rank array<bigint>, open array<boolean>"


def suffix_ranks(lines: DataFrame) -> DataFrame:
    """A row a document (DOCUMENT): its repeated lines, their ids, and the rank of the suffix that begins at each. lines(doc, part, at, h1, h2, words)."""
    ids = lines.groupBy(F.col("h1").alias("a"), F.col("h2").alias("b")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("r", F.lit(0).cast("long"))
    ids = stage(placed(ids).select(F.col("a").alias("h1"), F.col("b").alias("h2"), "n", "rank"), "ids")
    met = attach(lines, ids, ["h1", "h2"], "n", ["doc", "at"]).select("doc", "part", F.struct(*[F.col(c).cast("long").alias(c) for c in ("at", "words", "rank")]).alias("x"))
    x = met.groupBy("doc", "part").agg(F.array_sort(F.collect_set("x")).alias("x"))
    docs = stage(x.select("doc", "part", "x.at", "x.words", F.col("x.rank").alias("id"), "x.rank", F.transform("x", lambda _: F.lit(True)).alias("open")), "documents")
    h = 1
    while True:
        pairs = stage(docs.mapInArrow(_pairs(h), "doc bigint, part bigint, k bigint, r bigint, a bigint"), "pairs")
        groups = stage(placed(pairs.groupBy("r", "a").agg(F.count("*").alias("n")).withColumn("b", F.lit(0).cast("long"))).drop("b"), "groups")
        more = (F.col("n") > 1) & (F.col("a") >= 0)
        news = attach(pairs, groups, ["r", "a"], "n", ["doc", "k"]).groupBy("doc", "part").agg(F.collect_list(F.struct("k", "rank", more.alias("open"))).alias("news"))
        docs = stage(docs.join(news, ["doc", "part"], "left").mapInArrow(_updated, DOCUMENT), "documents")
        if groups.filter(more).limit(1).count() == 0:
            return docs
        h *= 2


def _suffixes(min_words: int):
    """Each suffix: rank, document, line, the ids of its first min_words lines, and the lengths of the deciding runs that begin there."""
    types = {"rank": pa.int64(), "doc": pa.int64(), "part": pa.int64(), "at": pa.int64(), "head": pa.binary(), "lengths": pa.list_(pa.int64())}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, _, _, (at, words, ids, rank) = _flat(batch, "at", "words", "id", "rank")
            if not len(owner):
                continue
            heads = np.stack([_ahead(owner, at, ids, h) if h else ids for h in range(min_words)], axis=1).astype("<i8")
            total, n = np.concatenate(([0], np.cumsum(words))), len(words)
            piece = np.cumsum(np.concatenate(([1], (owner[1:] != owner[:-1]) | (np.diff(at) != 1))))  # stretches of lines that follow one another
            lengths: list[set] = [set() for _ in range(n)]
            ends = np.searchsorted(total, total[:-1] + min_words)  # of the shortest runs from each line
            starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # and to each
            for i in np.flatnonzero((ends <= n) & (piece[np.minimum(ends, n) - 1] == piece)):
                lengths[i].add(int(ends[i]) - int(i))
            for j in np.flatnonzero((starts >= 0) & (piece[np.maximum(starts, 0)] == piece)):
                lengths[starts[j]].add(int(j) + 1 - int(starts[j]))
            doc, part = (batch.column(c).to_numpy()[owner] for c in ("doc", "part"))
            yield _batch({"rank": rank, "doc": doc, "part": part, "at": at, "head": [x.tobytes() for x in heads], "lengths": [sorted(x) for x in lengths]}, types)

    return run


INTERVALS = {"doc": pa.int64(), "part": pa.int64(), "at": pa.int64(), "m": pa.int64(), "range": pa.int32(), "begin": pa.int64(), "heads": pa.binary(), "begins": pa.list_(pa.int64())}


def common_prefix(heads: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Number of first lines that rows of the two matrices of line ids share; negative ids are past the end."""
    return np.logical_and.accumulate((heads == before) & (heads >= 0), axis=1).sum(axis=1)


def _intervals(most: int):
    """In the order of the suffix array: for each suffix and length m, where the interval of prefixes of m lines
    begins, as a place in this range, -1 if before it. At last a summary: the first and the last head, and for each
    length where the interval that is still open begins."""

    def run(batches):
        number, seen, begins, first, last = TaskContext.get().partitionId(), 0, np.full(most + 1, -1), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.frombuffer(b"".join(batch.column("head").to_pylist()), dtype="<i8").reshape(batch.num_rows, most)
            lcp = common_prefix(heads, np.concatenate((heads[:1] if last is None else last[None], heads[:-1])))
            if last is None:  # the first row's own is settled by the driver
                first, lcp[0] = heads[0], most
            place = seen + np.arange(len(lcp))
            here = np.where(lcp[:, None] < np.arange(most + 1)[None, :], place[:, None], -1)
            here = np.maximum.accumulate(np.maximum(here, np.where(place[:, None] == seen, begins[None, :], -1)), axis=0)
            lengths = batch.column("lengths")
            row = np.repeat(np.arange(batch.num_rows), lengths.value_lengths().to_numpy(zero_copy_only=False))
            m = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc, part, at = (batch.column(c).to_numpy()[row] for c in ("doc", "part", "at"))
            yield _batch({"doc": doc, "part": part, "at": at, "m": m, "range": np.full(len(m), number), "begin": here[row, m], "heads": [None] * len(m), "begins": [None] * len(m)}, INTERVALS)
            seen, begins, last = seen + len(lcp), here[-1], heads[-1]
        if last is not None:
            yield _batch({"doc": [None], "part": [None], "at": [None], "m": [None], "range": [number], "begin": [None], "heads": [first.tobytes() + last.tobytes()], "begins": [begins.tolist()]}, INTERVALS)

    return run


def intervals(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, part, at, m, range, begin: every run that may decide, and the interval of the suffix array that holds all its copies."""
    suffixes = docs.mapInArrow(_suffixes(min_words), "rank bigint, doc bigint, part bigint, at bigint, head binary, lengths array<bigint>")
    found = suffixes.orderBy("rank", "doc", "part", "at").mapInArrow(_intervals(min_words), "doc bigint, part bigint, at bigint, m bigint, range int, begin bigint, heads binary, begins array<bigint>")
    rows = stage(found, "intervals")
    known, open_at, last = [], None, None
    for x in rows.filter("m IS NULL").select("range", "heads", "begins").orderBy("range").collect():  # a row a task
        first, end = np.frombuffer(x["heads"], dtype="<i8").reshape(2, -1)
        shared = 0 if last is None else int(common_prefix(first[None], last[None])[0])
        # an interval that reaches into this range began where it began in an earlier one
        mine = [open_at[m] if m <= shared else (x["range"], 0) for m in range(min_words + 1)] if open_at else [(x["range"], 0)] * (min_words + 1)
        known += [(x["range"], m, *mine[m]) for m in range(min_words + 1)]
        open_at, last = [(x["range"], b) if b >= 0 else mine[m] for m, b in enumerate(x["begins"])], end
    known = F.broadcast(docs.sparkSession.createDataFrame(known, "range int, m bigint, from_range int, from_begin bigint"))  # min_words rows a task
    inside = F.col("begin") >= 0
    met = rows.filter("m IS NOT NULL").join(known, ["range", "m"], "left")
    return met.select("doc", "part", "at", "m", F.when(inside, F.col("range")).otherwise(F.col("from_range")).alias("range"), F.when(inside, F.col("begin")).otherwise(F.col("from_begin")).alias("begin"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, part, line: every line, by its place in the text, that a later copy of a repeated run covers."""
    lines = stage(_lines(docs), "lines")
    runs = stage(intervals(suffix_ranks(lines), min_words), "runs")
    of = ["m", "range", "begin"]
    firsts = runs.groupBy(*of).agg(F.min(F.struct("doc", "part", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = attach(runs, stage(firsts, "firsts"), of, "n", ["doc", "at"]).filter(F.struct("doc", "part", "at") != F.col("first"))
    spans = later.groupBy("doc", "part", "at").agg(F.max("m").alias("m"))
    covered = spans.select("doc", "part", F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("at")).distinct()
    return covered.join(lines.select("doc", "part", F.col("at").cast("long").alias("at"), "line").distinct(), ["doc", "part", "at"]).select("doc", "part", "line")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text_kept (the text without later copies of repeated runs), lines_deleted and
    runs (maximal deleted runs, in lines that hold words or not)."""
    docs = docs.drop(*ADDED)
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = repeated_runs(known, min_words).groupBy("doc", "part").agg(F.array_sort(F.collect_list("line")).alias("_gone"))
    gone = stage(gone.withColumnRenamed("doc", "_doc").withColumnRenamed("part", "_part"), "gone")
    joined = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64("text") == F.col("_part")), "left")
    # Between deleted lines what stays is cut out whole, so the work grows with the lines, not with their square.
    # L is bound once by the outer transform; a plain column would be evaluated anew for each gap.
    gaps = "flatten(transform(sequence(0, size(_gone)), i -> slice(L, IF(i = 0, 0, _gone[i - 1] + 1) + 1, IF(i = size(_gone), size(L), _gone[i]) - IF(i = 0, 0, _gone[i - 1] + 1))))"
    body = F.expr(f"transform(transform(array(split(text, '\n', -1)), L -> {gaps}), L -> array_join(L, '\n'))[0]")
    # With no word left, nothing of the text is worth keeping.
    kept = F.when(F.col("_gone").isNull(), F.col("text")).when(F.col("_body").rlike(r"[^\x20\x09-\x0D]"), F.col("_body")).otherwise("")
    joined = joined.withColumn("_body", F.when(F.col("_gone").isNotNull(), body))
    runs = F.expr("size(filter(_gone, (x, i) -> i = 0 OR _gone[i - 1] <> x - 1))")
    return joined.withColumn("text_kept", kept).withColumn("lines_deleted", F.coalesce(F.size("_gone"), F.lit(0)).cast("long")).withColumn("runs", F.when(F.col("_gone").isNull(), 0).otherwise(runs).cast("long")).drop("_doc", "_part", "_gone", "_body")
