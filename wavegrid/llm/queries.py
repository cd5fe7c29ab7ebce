"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm import bitsliced, credentials, decontaminate, exactdedup, language, licenses, linededup, packing, simhash, toxicity, urlfilter, variants, vectorcodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"), "spans")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_secrets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"), grams=True).withColumnRenamed("id", "doc_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bitsliced.top_k(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.transform("matches", lambda m: m["name"]), ",").alias("licenses"), "matches")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"id": "doc_id", "keep": "keep_id", "size": "group_size", "sha": "text_sha256"}
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents")).withColumnsRenamed(names)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontaminate, op3_lines, op4_language, op5_secrets, op6_topk, op7_urls, op8_toxicity, op9_packing, op10_licenses, op11_codes, op12_copies, op13_variants)}


def _codes_sql() -> str:
    """Product codes: two rounds of assignment and means, then the codes."""
    apart = "CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q, c)]) AS BIGINT) AS d"
    step = lambda k: f"""
        m{k} AS (SELECT vec_id, p, any_value(q) AS q, arg_min(struct_pack(e := e, d := d), d * 64 + e) AS m
                 FROM (SELECT v.vec_id, v.p, v.q, c.e, {apart} FROM parts v JOIN c{k} c USING (p)) GROUP BY vec_id, p),"""  # noqa: E731
    move = lambda k: f"""
        s{k} AS (SELECT p, m.e AS e, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM m{k}),
        t{k} AS (SELECT p, e, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM s{k} GROUP BY p, e, j),
        u{k} AS (SELECT p, e, list(x ORDER BY j) AS c FROM t{k} GROUP BY p, e),
        c{k + 1} AS (SELECT p, e, coalesce(u.c, o.c) AS c FROM c{k} o LEFT JOIN u{k} u USING (p, e)),"""  # noqa: E731
    return f"""
        WITH v AS (
            SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
            WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), parts AS (SELECT vec_id, p, q[p * len(q) // 16 + 1 : (p + 1) * len(q) // 16] AS q FROM v, (SELECT unnest(range(16)) AS p)),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v),
        c0 AS (SELECT p, e, q AS c FROM parts JOIN f USING (vec_id) WHERE e < 64),
        {step(0)}{move(0)}{step(1)}{move(1)}{step(2)}
        h AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(c, ',') AS x FROM c2)),
        r AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM m2 GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r JOIN v USING (vec_id), h"""


#: DuckDB's SQL for the queries that it can express.
ORACLE = {
    "op11_codes": _codes_sql(),
    "op12_copies": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM t
    """,
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
