"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted into cells (source, lang, topic) by tokens. Raking multiplies the cells'
weights in turn so that the sums by source, by language and by topic meet their target shares. A
cell's ratio of raked to present weight, times one factor for the whole corpus, is the probability
with which its documents stay; the factor makes the expected tokens meet the budget, with
probabilities held at 1. Whether a document stays depends on a hash of its id alone.

Targets, unless given: a marginal's shares to the power `temper`, normalised. Topic is what form a
text has (license, table, markup, figures, shouting, short or long prose), as the corpus has none.

Cells are as many as distinct (source, lang, topic). Up to LOCAL_CELLS they are raked in a single
task of that many rows; beyond, by grouping and joining, a staged table a round.

Cases: a null source, lang or text counts as empty; a text without words has weight 0 and stays; rows that
repeat a doc_id fare alike; a null doc_id hashes as the word null; an empty table gives an empty
result; other columns pass through, columns named like the added ones are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, stage, words_of

#: Rounds of raking, share of tokens to keep, power that tempers the marginals.
ROUNDS = 12
BUDGET = 0.8
TEMPER = 0.7
#: Steps in which the factor settles; each step only adds cells that are held at 1.
SETTLE = 12
LOCAL_CELLS = 50_000
MARGINS = ("source", "lang", "topic")
ADDED = ("topic", "n_tokens", "probability", "draw", "kept")
#: Topics by form; the first that holds. The same text is SQL for Spark and for DuckDB.
TOPIC_SQL = """CASE WHEN contains(t, 'icense') THEN 'license'
    WHEN contains(t, ' | ') THEN 'table'
    WHEN contains(t, '###') OR contains(t, '%%%') OR contains(t, '***') THEN 'markup'
    WHEN contains(t, '!! ') THEN 'shouting'
    WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'middle' ELSE 'long' END"""


def with_topic(docs: DataFrame) -> DataFrame:
    """docs with n_tokens (words) and topic."""
    out = docs.drop(*ADDED).withColumn("n_tokens", words_of(F.col("text"))).withColumn("_t", F.coalesce("text", F.lit("")))
    return out.withColumn("topic", F.expr(TOPIC_SQL.replace("contains(t,", "contains(_t,"))).drop("_t")


def _targets(cells: DataFrame, margin: str, temper: float, given: dict | None) -> DataFrame:
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("sum"))
    if given:
        share = F.coalesce(*[F.when(F.col(margin) == F.lit(k), F.lit(float(v))) for k, v in given.items()], F.lit(0.0))
    else:
        share = F.pow(F.col("sum") * F.lit(1.0), F.lit(temper))
    whole = sums.agg(F.sum(share).alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select(margin, (share / F.col("whole")).alias(f"t_{margin}"))  # whole: one row


def rake(cells: DataFrame, rounds: int = ROUNDS, temper: float = TEMPER, targets: dict | None = None, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """cells(source, lang, topic, tokens) with w, the raked weight; weights sum to the tokens."""
    cells = cells.filter("tokens > 0")
    few = cells.limit(local_cells + 1).count() <= local_cells
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    out = cells.coalesce(1) if few else cells
    for m in MARGINS:
        t = _targets(cells, m, temper, (targets or {}).get(m))
        out = out.join(F.broadcast(t), m) if few else out.join(t, m)  # few: at most local_cells rows
    out = stage(out.withColumn("w", F.col("tokens") * F.lit(1.0)), "cells")
    out = out.coalesce(1) if few else out
    for _ in range(rounds):
        for m in MARGINS:
            if few:  # one partition: these windows move nothing
                out = out.withColumn("w", F.col("w") * (F.col(f"t_{m}") * F.lit(float(total)) / F.sum("w").over(Window.partitionBy(m))))
            else:
                sums = stage(out.groupBy(m).agg(F.sum("w").alias("s"), F.count("*").alias("n")), "sums")
                out = attach(out, sums, [m], "n", [x for x in MARGINS if x != m]).withColumn("w", F.col("w") * (F.col(f"t_{m}") * F.lit(float(total)) / F.col("s"))).drop("s", "n")
        if not few:
            out = stage(out, "raked")
    return stage(out.select(*MARGINS, "tokens", "w"), "weights")


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """source, lang, topic, probability, and the expected share; the factor settles in at most SETTLE steps."""
    total = raked.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    want, ratio, factor = budget * total, F.col("w") / F.col("tokens"), budget
    for _ in range(SETTLE):
        held = ratio * F.lit(factor) >= 1
        row = raked.agg(F.coalesce(F.sum(F.when(held, F.col("tokens"))), F.lit(0)).alias("at_1"), F.coalesce(F.sum(F.when(~held, F.col("w"))), F.lit(0.0)).alias("rest")).first()
        new = (want - row["at_1"]) / row["rest"] if row["rest"] > 0 else factor
        if new <= factor:
            break
        factor = new
    return raked.select(*MARGINS, F.least(F.lit(1.0), ratio * F.lit(factor)).alias("probability"))


def mix(docs: DataFrame, budget: float = BUDGET, temper: float = TEMPER, rounds: int = ROUNDS, targets: dict | None = None, seed: str = "mix", local_cells: int = LOCAL_CELLS) -> DataFrame:
    """docs with topic, n_tokens, probability (of staying), draw (in [0, 1)) and kept.

    targets: {"lang": {"en": 0.5, ...}, ...}; a value that a given marginal leaves out gets no weight."""
    shaped = with_topic(docs)
    keys = [F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"_{m}") for m in MARGINS]
    cells = shaped.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).toDF(*MARGINS, "tokens", "rows")
    cells = stage(cells, "cells")
    p = probabilities(rake(cells.drop("rows"), rounds, temper, targets, local_cells), budget)
    p = cells.join(p, list(MARGINS), "left").select(*[F.col(m).alias(f"_{m}") for m in MARGINS], "rows", F.coalesce("probability", F.lit(1.0)).alias("probability"))
    p = stage(p, "probabilities")
    rows = shaped.select("*", *keys)
    few = p.limit(local_cells + 1).count() <= local_cells
    joined = rows.join(F.broadcast(p.drop("rows")), [f"_{m}" for m in MARGINS]) if few else attach(rows, p, [f"_{m}" for m in MARGINS], "rows", ["doc_id"])
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f"|{seed}"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    out = joined.withColumn("draw", draw).withColumn("kept", F.col("draw") < F.col("probability"))
    return out.drop(*[f"_{m}" for m in MARGINS], "rows")


def oracle(rounds: int = ROUNDS, budget: float = BUDGET, temper: float = TEMPER, seed: str = "mix", steps: int = SETTLE) -> str:
    """The same in DuckDB's SQL, rounds and steps written out."""
    topic = TOPIC_SQL.replace("\n", " ")
    ctes = [
        rf"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, n_tokens
             FROM (SELECT *, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents))""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "n AS (SELECT sum(tokens)::DOUBLE AS n FROM c)",
    ]
    for m in MARGINS:
        ctes.append(f"m_{m} AS (SELECT {m}, pow(sum(tokens), {temper}) / sum(pow(sum(tokens), {temper})) OVER () AS t_{m} FROM c GROUP BY {m})")
    ctes.append("r0 AS (SELECT *, tokens::DOUBLE AS w FROM c CROSS JOIN n " + " ".join(f"JOIN m_{m} USING ({m})" for m in MARGINS) + ")")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * (t_{m} * n / sum(w) OVER (PARTITION BY {m})) AS w) FROM r{k})")
            k += 1
    ctes.append(f"f0 AS (SELECT {budget}::DOUBLE AS f)")
    for i in range(steps):
        ctes.append(f"""f{i + 1} AS MATERIALIZED (SELECT CASE WHEN x > f THEN x ELSE f END AS f FROM (SELECT f, ({budget} * n - at_1) / nullif(rest, 0) AS x FROM
            (SELECT any_value(f) AS f, any_value(n) AS n, coalesce(sum(tokens) FILTER (w / tokens * f >= 1), 0) AS at_1, coalesce(sum(w) FILTER (w / tokens * f < 1), 0) AS rest FROM r{k}, f{i})))""")
    ctes.append(f"p AS (SELECT source, lang, topic, least(1.0, w / tokens * f) AS probability FROM r{k}, f{steps})")
    return "WITH " + ",\n".join(ctes) + f"""
        SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability, draw < probability AS kept
        FROM (SELECT d.*, coalesce(p.probability, 1.0) AS probability, ('0x' || substr(md5(doc_id::VARCHAR || '|{seed}'), 1, 12))::BIGINT / {1 << 48}::DOUBLE AS draw
              FROM d LEFT JOIN p USING (source, lang, topic))"""
