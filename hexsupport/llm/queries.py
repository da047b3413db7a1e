"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexsupport.llm import bpe, centroids, counts, embeddings, langid, licenses, lines, mixing, ngrams, pii, quality, runs, urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, bytes_col="decoded")
    return bpe.digests(ids.drop("text"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rules(spark, URL_RULES)).drop("url")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).drop("text")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.linked(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = pii.detected(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.number_of("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return marked.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    texts = documents.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(texts, langid.trained_on(documents)).drop("text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(listed, ",").alias("licenses"), best.alias("coverage"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.counted(texts, public_tokenizers.path("byte_bpe_50k.json"), limit=512, keep_text=False)


def planted(docs: DataFrame) -> DataFrame:
    """Of documents whose ``crc32(doc_id)`` divides by 10, the words from some place on repeat with some period (see the contract)."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    hash_, n, w = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("_w").cast("long"), F.col("_w")
    g = F.floor(hash_ / 10)
    a = g % F.col("_n")
    p = 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))
    tail = F.flatten(F.array_repeat(F.slice(w, F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")))
    made = F.array_join(F.concat(F.slice(w, 1, F.col("_a")), F.slice(tail, 1, F.col("_n") - F.col("_a"))), " ")
    out = docs.withColumn("_w", F.when((hash_ % 10 == 0) & F.col("text").isNotNull(), words)).withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, a).cast("int")).withColumn("_p", p.cast("int"))
    return out.withColumn("text", F.when(F.col("_n") > 0, made).otherwise(F.col("text"))).select(*docs.columns)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.col("_best")
    found = runs.periodic(docs, keep_text=False).withColumn("_best", runs.greatest())
    ratio = F.floor(1000 * best["length"] / best["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), ratio.alias("exponent_milli"),
        F.sha2(runs.listed().cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round spelled out as two tables: the assignment by the last centroids, and the next centroids."""
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS j, e AS c FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k})
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(e) AS e, min(d) AS d, arg_min(j, d * {k} + j) AS j FROM (
    SELECT rid, vec_id, e, j, list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}
  ) GROUP BY rid
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.j, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
      SELECT j, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT j, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{i}) GROUP BY j, i
    ) GROUP BY j
  ) m ON m.j = o.j
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, a.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j
"""


_SQL = {
    "op11_centroid_clustering": _lloyd_sql(),
    "op2_url_filters": r"""
WITH r(rule, verdict, h, p) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), w AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM v
), m AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM w JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM w LEFT JOIN m USING (page_id)
""",
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), edge AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM edge GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
""",
    "op5_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
