"""The queries op1_ to op13_ over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}
_WORDS = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op8_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op9_warc",
    r"""
    WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM t)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
    FROM g""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import roundtrip

    return roundtrip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _mixing_sql() -> str:
    from .mixing import oracle

    return oracle()


@query("op3_mixing", _mixing_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, drop=True)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_TOPK_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op1_topk", _TOPK_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


# A plain reading of the driver's pages, whose article is one element that holds nothing else and is closed.
_TEXT_SQL = r"""
    WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1), '</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote|table|tr|td|th)(?: [^>]*)?>') AS blocks FROM pages),
    t AS (SELECT page_id, url, list_transform(blocks, lambda b: regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;?', '&', 'g')) AS texts FROM a),
    j AS (SELECT page_id, url, array_to_string(list_filter(list_transform(texts, lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text FROM t)
    SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM j"""


@query("op10_main_text", _TEXT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


_NEAR_SQL = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(array_to_string(unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END), ' ')) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
    t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
    SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, doc_id = min(r.b) AS kept FROM r JOIN documents ON doc_id = r.a LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


@query("op5_near_dedup", _NEAR_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


_LINES_SQL = rf"""
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    l AS (SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '{_WORDS}')) AS words FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM l WHERE words > 0),
    q AS (SELECT doc_id, list(line ORDER BY pos) AS s, list(words ORDER BY pos) AS n FROM k GROUP BY doc_id),
    w AS (SELECT doc_id, pos, m, md5(array_to_string(s[pos:pos + m - 1], chr(10))) AS run FROM q, unnest(range(1, len(s) + 1)) AS a(pos), unnest(range(1, 11)) AS b(m)
          WHERE pos + m - 1 <= len(s) AND list_sum(n[pos:pos + m - 1]) >= 10),
    f AS (SELECT run, min({{'d': doc_id, 'a': pos}}) AS first FROM w GROUP BY run HAVING count(*) > 1),
    c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + m)) AS pos FROM w JOIN f USING (run) WHERE {{'d': doc_id, 'a': pos}} <> first),
    g AS (SELECT DISTINCT doc_id, i FROM c JOIN k USING (doc_id, pos)),
    x AS (SELECT doc_id, count(*) AS gone, count(*) FILTER (p IS NULL OR p <> i - 1) AS runs FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g) AS o GROUP BY doc_id),
    b AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body, max(words) AS most FROM l ANTI JOIN g USING (doc_id, i) GROUP BY doc_id),
    z AS (SELECT docs.doc_id, gone, runs, CASE WHEN gone IS NULL THEN docs.text WHEN coalesce(most, 0) > 0 THEN body ELSE '' END AS t FROM documents AS docs LEFT JOIN x USING (doc_id) LEFT JOIN b USING (doc_id))
    SELECT doc_id, coalesce(gone, 0)::BIGINT AS lines_deleted, coalesce(runs, 0)::BIGINT AS runs, length(t)::BIGINT AS n_chars_kept, sha256(t) AS text_sha256 FROM z"""


@query("op4_line_dedup", _LINES_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_deleted", "runs", F.length("text_kept").cast("long").alias("n_chars_kept"), F.sha2("text_kept", 256).alias("text_sha256"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score_toxicity

    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op6_chat")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, train, transcripts_of

    conversations = table(spark, sf_dir, "conversations")
    out = format_chats(transcripts_of(conversations), train(conversations))
    return out.select("conv_id", F.size("roles").cast("long").alias("n_turns"), "roles", F.col("truth").alias("roles_given"), F.sha2("rendered", 256).alias("rendered_sha256"), F.length("rendered").cast("long").alias("n_chars"))


_FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{n}", "text"))
_MERKLE_SQL = f"""
    WITH RECURSIVE d AS (SELECT *, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                lambda a, x: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(a, x)), 4294967295::BIGINT) AS crc FROM documents),
    l AS (SELECT doc_id, lang, sha256({_FIELDS.replace("{n}", "n_chars")}) AS leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256({_FIELDS.replace("{n}", "(n_chars + 1)")}) END AS changed FROM d),
    p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
    t AS (SELECT lang, 0 AS lev, pos, leaf AS node, n FROM p
          UNION ALL SELECT lang, lev + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY lang, lev, pos // 2),
    s AS (SELECT lang, lev AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (SELECT 0 AS lev, pos, subroot AS node, n FROM s
          UNION ALL SELECT lev + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY lev, pos // 2),
    r AS (SELECT lev AS height, node AS root FROM u WHERE n = 1),
    e AS (SELECT p.doc_id, p.leaf, x.lev, p.pos >> x.lev AS side, t.node AS sib FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang, unnest(range(s.height)) AS x(lev)
          LEFT JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.lev = x.lev AND t.pos = xor(p.pos >> x.lev, 1)
          UNION ALL SELECT p.doc_id, p.leaf, 1000 + x.lev, s.pos >> x.lev, u.node FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN r, unnest(range(r.height)) AS x(lev)
          LEFT JOIN u ON u.lev = x.lev AND u.pos = xor(s.pos >> x.lev, 1)),
    f AS (SELECT doc_id, leaf, list(CASE WHEN sib IS NULL THEN '-' WHEN side % 2 = 1 THEN 'L' || sib ELSE 'R' || sib END ORDER BY lev) AS path, coalesce(string_agg(sib, '' ORDER BY lev), '') AS sibs FROM e GROUP BY ALL),
    o AS (SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(f.sibs, '')) AS proof_sha256,
                 list_reduce(coalesce(f.path, []), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END), coalesce(p.changed, p.leaf)) AS folded_root
          FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN r LEFT JOIN f ON f.doc_id = p.doc_id AND f.leaf = p.leaf)
    SELECT *, folded_root = root AS verified FROM o"""


@query("op13_merkle", _MERKLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import verified

    return verified(table(spark, sf_dir, "documents"))


_NEGATIVES_SQL = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
          FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", noisy)
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _licenses_sql() -> str:
    from .licenses import oracle

    return oracle()


@query("op11_licenses", _licenses_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import summary

    return summary(table(spark, sf_dir, "documents"))
