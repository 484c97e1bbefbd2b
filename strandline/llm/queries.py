"""Registered forms of the operators: each applies its operator to whole tables and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import language_id, lm_score, pieces, toxicity, url_filter
from .centroids import K, ROUNDS, cluster_vectors
from .exact_dedup import exact_duplicates
from .mixing import TRIES, mix
from .near_dedup import near_duplicates
from .packing import pack
from .registry import ORACLES, QUERIES, query, table  # noqa: F401
from .substrings import remove_repeats
from .toxicity import held_out
from .vectors import near_vectors
from .whitening import whiten

EXACT_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)"""


@query("op1_near_vectors")
def op1(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")


@query("op3_exact_dedup", EXACT_SQL)
def op3(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("bucket", "chain")


@query("op4_url_filter")
def op4(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query("op5_lm_score")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, ~held_out("doc_id", 7, 2)).withColumn("held_out", held_out("doc_id", 7, 2))


@query("op6_language_id")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out("doc_id", 3, 1)))
    return language_id.predict(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@query("op7_sentencepiece")
def op7(spark, sf_dir):
    """Per document: number and crc32 of its ids, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents")
    return pieces.round_trip(docs)


@query("op8_near_dedup")
def op8(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op11_whitening")
def op11(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


def centroids_sql(k: int, rounds: int) -> str:
    """The rounds written out, over rows (vector, component)."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"

    def nearest(r):
        return f"""a{r} AS MATERIALIZED (SELECT v.row, min(struct_pack(d := {square}, c := c.c)) AS best FROM v, c{r} AS c GROUP BY v.row)"""

    def mean(r):
        return f"""m{r} AS MATERIALIZED (SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY i) AS x FROM (
  SELECT a.best.c AS c, e.i, sum(v.x[e.i])::BIGINT AS t, count(*)::BIGINT AS n FROM a{r} AS a JOIN v USING (row), (SELECT unnest(range(1, 65)) AS i) AS e GROUP BY 1, 2) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN m{r} AS m USING (c))"""

    steps = ",\n".join(part for r in range(rounds) for part in (nearest(r), mean(r)))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda e: e IS NULL OR NOT isfinite(e)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x FROM v ORDER BY sha256('3:' || vec_id), x LIMIT {k}),
{steps},
{nearest(rounds)}
SELECT v.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN a{rounds} AS a USING (row) JOIN c{rounds} AS c ON c.c = a.best.c"""


@query("op12_centroid_clusters", centroids_sql(K, ROUNDS))
def op12(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


DRAW = "('0x' || substr(h, {at}, 12))::BIGINT / 281474976710656::DOUBLE"
TRIED = "(u + w * {k} - floor(u + w * {k}))"
MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, size, {DRAW.format(at=1)} AS u, {DRAW.format(at=13)} AS w FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('13:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS most, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE AS words, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS among
  FROM s WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most * among < weight * words AS stops FROM o),
t AS (SELECT source, source_size, CASE WHEN stops THEN most::DOUBLE ELSE weight * (sum(source_size) OVER () - coalesce(sum(most) FILTER (stops) OVER (), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) FILTER (stops) OVER (), 0)) END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM t),
e AS (SELECT r.source, k, abs(floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN {TRIED.format(k="k")} < rate - floor(rate) THEN size ELSE 0 END) - any_value(target)) AS miss
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range({TRIES})) AS k) GROUP BY r.source, k),
c AS (SELECT source, min((miss, k))[2] AS k FROM e GROUP BY source)
SELECT doc_id, size, source_size, target, size * (floor(rate) + ({TRIED.format(k="k")} < rate - floor(rate))::INTEGER)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN c ON c.source IS NOT DISTINCT FROM r.source"""


@query("op13_source_mix", MIX_SQL)
def op13(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
