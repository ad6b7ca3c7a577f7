"""The operators as queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airsift.llm.centroids import cluster_vectors
from airsift.llm.common import crc32_of_id, work_folder
from airsift.llm.extraction import main_text
from airsift.llm.importance import resample
from airsift.llm.jaccard import similarity_join
from airsift.llm.katz import score_texts
from airsift.llm.mixing import mix_sources
from airsift.llm.neighbours import nearest_neighbours
from airsift.llm.packing import pack
from airsift.llm.quality import quality_rules
from airsift.llm.semantic import fit as fit_quality
from airsift.llm.semantic import score_quality
from airsift.llm.shards import read_documents, write_shards
from airsift.llm.toxicity import fit, score_toxicity
from airsift.llm.urls import Vocabulary, filter_urls

URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, F.col("vec_id") % 20 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES, keep=["page_id"])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), added_tokens=True)


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), crc32_of_id() % 10 == 0)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), folder, added_tokens=True)
    return read_documents(spark, folder)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = docs.withColumn("held_out", crc32_of_id() % 4 == 2)
    return score_toxicity(held_out, model, keep=["doc_id", "held_out"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, keep=["doc_id"])


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    held_out = docs.withColumn("held_out", crc32_of_id() % 5 == 0)
    return score_quality(held_out, model, keep=["doc_id", "held_out"])


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neighbours": op1_neighbours,
        "op2_url_filter": op2_url_filter,
        "op3_packing": op3_packing,
        "op4_katz": op4_katz,
        "op5_ngram_join": op5_ngram_join,
        "op6_token_shards": op6_token_shards,
        "op7_main_text": op7_main_text,
        "op8_source_mix": op8_source_mix,
        "op9_toxicity": op9_toxicity,
        "op10_quality_rules": op10_quality_rules,
        "op11_centroids": op11_centroids,
        "op12_quality": op12_quality,
        "op13_resample": op13_resample,
    }


def _url_sql() -> str:
    words = Vocabulary()
    terms = ", ".join(
        f"('{form}', '{term}', {weight}, {strict})"
        for form, (term, weight, strict) in words.listed().items()
    )

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return (
            f"((host = '{host}' OR ends_with(host, '.{host}')) "
            f"AND starts_with(path, '/{path}'))"
        )

    ordered = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in ordered)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
    CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN ''
      ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low,
    translate(regexp_extract(rest, '^[^/]*'), '{upper}', '{lower}') AS host,
    CASE WHEN strpos(rest, '/') = 0 THEN '' ELSE substr(rest, strpos(rest, '/')) END AS path
  FROM cut),
terms AS (SELECT * FROM (VALUES {terms}) t(form, term, weight, strict)),
hits AS (
  SELECT DISTINCT low, term, weight, strict
  FROM (SELECT low, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS form FROM parts)
  JOIN terms USING (form)),
sums AS (
  SELECT low, count(*) FILTER (strict) AS n_strict, count(*) FILTER (NOT strict) AS n_soft,
    sum(weight) FILTER (NOT strict) AS soft_weight
  FROM hits GROUP BY low),
found AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(n_strict, 0)::INT AS n_strict,
    coalesce(n_soft, 0)::INT AS n_soft, coalesce(soft_weight, 0)::DOUBLE AS soft_weight
  FROM parts LEFT JOIN sums USING (low))
SELECT page_id, host, path, rule,
  CASE {verdict}
    WHEN n_strict > 0 OR soft_weight >= {words.limit} THEN 'block' ELSE 'allow' END AS verdict,
  n_strict, n_soft, soft_weight
FROM found"""


_MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, '')) || md5(coalesce(text, '')) AS key
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER ()
      - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    )::DOUBLE / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sizes WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size,
    CASE WHEN cap <= level * weight THEN cap::DOUBLE
      ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target
  FROM levels),
plan AS (
  SELECT source, source_size, target, greatest(target - whole * source_size, 0.0) AS need, whole
  FROM (SELECT *, CASE WHEN source_size > 0
      THEN floor((target + 0.5) / source_size)::BIGINT ELSE 0 END AS whole FROM targets)),
order_keys AS (
  SELECT source, key, size, n, sum(size * n) OVER (PARTITION BY source ORDER BY key) - size * n AS before
  FROM (SELECT source, key, any_value(size) AS size, count(*) AS n FROM docs GROUP BY source, key)),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY source, key) AS turn FROM docs)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (d.size * (p.whole + CASE
    WHEN k.before + k.size * k.n <= p.need THEN 1
    WHEN k.before <= p.need AND d.turn <= ceil((p.need - k.before) / k.size - 0.5) THEN 1
    ELSE 0 END))::BIGINT AS taken
FROM turns d
JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
JOIN order_keys k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key"""


_KEPT_VECTORS = """
WITH kept AS (
  SELECT row_number() OVER () AS row_id, vec_id,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY name, v) - 1 AS k, v
  FROM (SELECT v, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS name FROM kept)
  ORDER BY name, v LIMIT 40)"""


def _centroid_sql(rounds: int = 5) -> str:
    """The rounds one after another, every distance computed anew."""
    steps = [_KEPT_VECTORS]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS k,
    min(d)::BIGINT AS d
  FROM (SELECT row_id, vec_id, s.v, k, list_inner_product(s.v, s.v)
          - 2 * list_inner_product(s.v, c.v) + list_inner_product(c.v, c.v) AS d
        FROM kept s CROSS JOIN c{r} c)
  GROUP BY row_id)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT k, list(floor(total / n) ORDER BY i) AS v
  FROM (SELECT k, i, sum(x) AS total, count(*) AS n
        FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r})
        GROUP BY k, i)
  GROUP BY k
  UNION ALL SELECT k, v FROM c{r} WHERE k NOT IN (SELECT k FROM a{r}))""")
    return ",".join(steps) + f"""
SELECT vec_id, a.k::INT AS cluster, d AS distance,
  (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": _url_sql(),
        "op8_source_mix": _MIX_SQL,
        "op11_centroids": _centroid_sql(),
    }
