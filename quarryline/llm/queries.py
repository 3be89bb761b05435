"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, annular, bpe, htmltext, langid, media, packing, quality, simhash, tokenio, urlfilter, vafile, weak

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scored = quality.classify(docs, docs, labels.where(langid.not_held_out(labels["doc_id"])))
    return scored.select("doc_id", F.coalesce(~langid.not_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.identify(docs, docs.where(langid.not_held_out(docs["doc_id"])), vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", F.coalesce(~langid.not_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "langid.lang_pred", "langid.score")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_features(media.store_texts(_read(spark, sf_dir, "documents")))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(_read(spark, sf_dir, "embeddings"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_read(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenio.read_tokens(tokenio.write_tokens(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", *weak.STATISTICS[:5], weak.base_failed().alias("base_failed"), weak.kept().alias("kept"), "quality_probability")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annular.compress(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_quality, op4_langid, op5_media, op6_topk, op7_html, op8_bpe, op9_tokens, op10_packing, op11_weak_rules, op12_align, op13_codes)}

_HOST = "translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1)"
# the SQL is left as it is given: its net/de/ blocks, where the contract, and so RULES, allows
_RULES = "('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')"


def _step(book: str, n: int) -> str:
    """Each part's nearest entry of a codebook table (p, e, c), as table a<n>."""
    return f"""
        a{n} AS (SELECT r, p, min({{'d': d, 'e': e}}) AS m FROM (
          SELECT x.r, x.p, b.e, CAST(list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN {book} b ON x.p = b.p) GROUP BY r, p)"""


def _renewed(book: str, n: int) -> str:
    """The floor of the mean of each entry's parts, as table b<n>."""
    return f"""
        s{n} AS (SELECT p, e, i, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM (SELECT x.p, a.m.e AS e, unnest(x.c) AS v, unnest(range(len(x.c))) AS i FROM x JOIN a{n} a ON x.r = a.r AND x.p = a.p) GROUP BY p, e, i),
        l{n} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY p, e),
        b{n} AS (SELECT b.p, b.e, coalesce(l.c, b.c) AS c FROM {book} b LEFT JOIN l{n} l ON b.p = l.p AND b.e = l.e)"""


SQL = {
    "op2_url_filter": f"""
        WITH u AS (SELECT row_number() OVER () AS r, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        rules(h, p, v) AS (VALUES {_RULES}),
        best AS (SELECT r, max({{'n': length(h) + length(p), 'hn': length(h), 'rule': h || p, 'v': v}}) AS b FROM u JOIN rules
                 ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM u LEFT JOIN best USING (r)""",
    "op6_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
          (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op13_codes": f"""
        WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
        x AS (SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS c FROM k, range(16) t(p)),
        b0 AS (SELECT p, r - 1 AS e, c FROM x WHERE r <= 64),{_step("b0", 1)},{_renewed("b0", 1)},{_step("b1", 2)},{_renewed("b1", 2)},{_step("b2", 3)},
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
        c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a3 GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h""",
}
