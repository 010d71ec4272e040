"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is its words (runs of letters, lower-cased), read in overlapping windows of WINDOW words every
STRIDE words; the last window ends with the text. Each word enters by word and character inputs: a trained
vector of the word, the mean of the trained vectors of its character n-grams, and seven numbers: the
log-odds of the word, the largest, second largest and mean log-odds of its character n-grams, those of
its beginnings, and its length. The log-odds are of toxic training documents against others, shrunk
towards 0; for a training document they leave out that document itself, so that the network doesn't
learn to trust words it has only seen there. Vectors are trained with the network; in training each is left
out now and then, for the same reason. Words in one training document only, and n-grams in two, have none. Two gated recurrent layers read a window in either
direction, attention weighs their states, and a logistic unit scores the sum. A document's score is
its highest window's.

Training takes labelled rows only where crc32(doc_id as text) mod 4 is not 2, at most TOXIC_ROWS
toxic and CLEAN_ROWS others of at most TRAIN_CHARS characters, those with the least hash of the id; shares are corrected to those of all
labelled rows. Near copies among them count once. Each gives its most suspicious window, clean ones a random
window too; the number of gradient steps is the same for any sample. Labels, lang,
source and doc_id are not inputs.

Cases: a text that is null or has no word gets the score of an empty window; texts are read whole; of several
labels of one document the highest counts; without any label, or with labels of one kind only, the
score is the smoothed share of toxic rows; repeated rows fare alike; an empty table gives an empty result; other
columns are ignored."""

from __future__ import annotations

import os
import pickle
import subprocess
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, slices
from .network import HIDDEN, INPUTS, NUMBERS, SEED, THRESHOLD, VECTOR, WINDOW, Network, Scorer, Vectors, _sigmoid, grams, train, windows, words_in  # noqa: F401

#: Bounds of the training sample: rows of either label, characters of a row.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS = 1500, 2000, 200_000


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


def trained_apart(rows: list[tuple[str, int]], share: float | None = None) -> Scorer:
    """train() in a process of its own, so that what training holds goes back to the machine when it ends: the
    driver's interpreter, which lives as long as the session, would keep it."""
    path = os.pathsep.join(p for p in sys.path if p)
    child = subprocess.run([sys.executable, "-c", f"from {train.__module__} import answer; answer()"], input=pickle.dumps((rows, share)), capture_output=True, env=os.environ | {"PYTHONPATH": path})
    if child.returncode:
        raise RuntimeError(f"training failed: {child.stderr.decode(errors='replace')[-2000:]}")
    return pickle.loads(child.stdout)


def fit_scorer(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Trains on the bounded sample of labelled rows that are not held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select(F.col("doc_id").alias("_id"), "toxic", F.xxhash64("doc_id").alias("_h"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counts:
        return train([])
    sample = None
    for y, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        some = known.filter(F.col("toxic") == y).orderBy("_h").limit(most)
        sample = some if sample is None else sample.unionByName(some)
    rows = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min(F.struct("text", "toxic")).alias("r"))
    rows = [(x["r"]["text"], x["r"]["toxic"]) for x in rows.collect()]  # at most TOXIC_ROWS + CLEAN_ROWS
    return trained_apart(rows, counts.get(1, 0) / sum(counts.values()))


def _score(sent):
    @giving_back
    def run(batches):
        scorer = sent.value
        for whole in batches:
            for batch in slices(whole, "text"):
                score = scorer.score([x or "" for x in batch.column("text").to_pylist()])
                keep = [i for i, n in enumerate(batch.schema.names) if n not in ("score", "predicted")]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())], [*(batch.schema.names[i] for i in keep), "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """docs with score and predicted for every row. The scorer, some MB, goes to the workers."""
    scorer = scorer or fit_scorer(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    return docs.mapInArrow(_score(sent), T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
