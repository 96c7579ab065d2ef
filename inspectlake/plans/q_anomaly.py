"""Queries on embeddings: neighbours, scores, calibration, components, PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectlake.functions import boxes as bx
from inspectlake.operators import anomaly as an, decide
from inspectlake.plans.registry import query

R = lambda c: F.round(c, 6).alias(c)
DIST = "sqrt(list_sum(list_transform(list_zip({0}.embedding, {1}.embedding), lambda z: (z[1]::double - z[2]::double) ** 2)))"
KNN = f"""
WITH d AS (SELECT q.vec_id AS query_id, b.vec_id AS bank_id, {DIST.format('q', 'b')} AS distance FROM v_queries q CROSS JOIN v_bank b),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, bank_id) AS rank FROM d QUALIFY rank <= 3)"""
# Fixed calibration numbers for queries that only score.
MEAN, P99 = 0.9, 1.15
SCORE = f"least(greatest(tanh((distance - {MEAN}) / (2 * {P99 - MEAN!r})), 0.0), 1.0)"


@query("src_embeddings", """
SELECT vec_id, CASE WHEN len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'dimension' ELSE 'not finite' END AS issue FROM
  (SELECT vec_id, CASE vec_id % 50 WHEN 7 THEN [] WHEN 9 THEN embedding[1:60] WHEN 11 THEN list_append(embedding[1:63], 'inf'::float) ELSE embedding END AS embedding FROM embeddings)
WHERE len(embedding) <> 64 OR len(list_filter(embedding, lambda v: isinf(v) OR isnan(v))) > 0""")
def _(t):
    broken = F.expr("""CASE vec_id % 50 WHEN 7 THEN cast(array() AS array<float>) WHEN 9 THEN slice(embedding, 1, 60)
      WHEN 11 THEN concat(slice(embedding, 1, 63), array(cast('Infinity' AS float))) ELSE embedding END""")
    return an.check_vectors(t.embeddings.withColumn("embedding", broken), "vec_id")


@query("join_knn_exact", KNN + " SELECT query_id, rank, bank_id, round(distance, 6) AS distance FROM k")
def _(t):
    return an.knn_exact(t.queries, t.bank, 3).select("query_id", "rank", "bank_id", R("distance"))


@query("join_knn_ivf")
def _(t):
    return an.knn_ivf(t.queries, t.bank, 3).select("query_id", "rank", "bank_id", R("distance"))


@query("agg_anomaly_score", KNN + f" SELECT query_id AS vec_id, round({SCORE}, 6) AS score FROM k WHERE rank = 1")
def _(t):
    near = an.nearest_distances(t.queries, t.bank)
    return near.select("vec_id", F.round(an.anomaly_score("distance", MEAN, P99), 6).alias("score"))


# Sixteen vectors make one 4 x 4 patch image.
PATCHES = "SELECT vec_id, cast(floor(vec_id / 16) AS bigint) AS image_id, cast(floor(vec_id % 16 / 4) AS int) AS patch_row, cast(vec_id % 4 AS int) AS patch_col, embedding FROM {embeddings}"
MAPS = f"""
WITH RECURSIVE p AS ({PATCHES}), w AS (SELECT * FROM p WHERE image_id IN (SELECT image_id FROM p GROUP BY 1 HAVING count(*) = 16)),
n AS (SELECT w.vec_id, image_id, patch_row, patch_col, min({DIST.format('w', 'b')}) AS distance FROM w CROSS JOIN v_bank b GROUP BY ALL),
m AS (SELECT *, {SCORE} AS score FROM n),
g AS (SELECT *, max(score) OVER (PARTITION BY image_id) AS peak FROM m QUALIFY peak >= 0.3),
h AS (SELECT * FROM g WHERE score >= greatest(0.3 * 0.5, peak * 0.3)),
r AS (SELECT image_id, patch_row, patch_col, patch_row * 100 + patch_col AS label FROM h UNION
  SELECT h.image_id, h.patch_row, h.patch_col, r.label FROM r JOIN h ON h.image_id = r.image_id AND abs(h.patch_row - r.patch_row) + abs(h.patch_col - r.patch_col) = 1),
l AS (SELECT image_id, patch_row, patch_col, min(label) AS label FROM r GROUP BY ALL),
c AS (SELECT l.image_id, label, min(l.patch_col) AS col0, min(l.patch_row) AS row0, max(l.patch_col) + 1 AS col1, max(l.patch_row) + 1 AS row1, max(score) AS score, count(*) AS patches
  FROM l JOIN h USING (image_id, patch_row, patch_col) GROUP BY l.image_id, label)"""


def maps(t):
    return an.anomaly_maps(t.select(PATCHES), t.bank, "image_id", 4, 4, MEAN, P99)


def hot(t):
    return an.hot_patches(an.gated_maps(maps(t)[0], "image_id", 0.3), 0.3)


def boxes(t):
    return an.component_boxes(an.patch_components(hot(t), "image_id"), 4, 4, 50, 30)


@query("agg_anomaly_map", MAPS + " SELECT image_id, patch_row, patch_col, round(score, 6) AS score FROM m")
def _(t):
    return maps(t)[0].select("image_id", "patch_row", "patch_col", R("score"))


@query("agg_anomaly_summary", MAPS + " SELECT image_id, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, count(*) AS patches FROM m GROUP BY 1")
def _(t):
    return an.anomaly_summary(maps(t)[0], "image_id").select("image_id", R("min_score"), R("max_score"), R("mean_score"), "patches")


@query("flt_anomaly_gate", MAPS + " SELECT DISTINCT image_id, round(peak, 6) AS peak FROM g")
def _(t):
    return an.gated_maps(maps(t)[0], "image_id", 0.3).select("image_id", R("peak")).distinct()


@query("flt_hot_patches", MAPS + " SELECT image_id, patch_row, patch_col FROM h")
def _(t):
    return hot(t).select("image_id", "patch_row", "patch_col")


@query("agg_components", MAPS + " SELECT image_id, col0, row0, col1, row1, patches, round(score, 6) AS score FROM c")
def _(t):
    return an.patch_components(hot(t), "image_id").select("image_id", "col0", "row0", "col1", "row1", "patches", R("score"))


@query("srt_components", MAPS + " SELECT image_id, col0 * 12.5 AS rx0, row0 * 7.5 AS ry0, round(score, 6) AS score FROM c ORDER BY score DESC")
def _(t):
    return an.component_order(boxes(t)).select("image_id", "rx0", "ry0", R("score"))


@query("agg_candidate_from_component", MAPS + """, b AS (SELECT image_id, cast(round_even(100 + col0 * 12.5, 0) AS int) AS x0, cast(round_even(200 + row0 * 7.5, 0) AS int) AS y0,
  cast(round_even(100 + col1 * 12.5, 0) AS int) AS x1, cast(round_even(200 + row1 * 7.5, 0) AS int) AS y1, round(score, 6) AS score FROM c)
SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) AS area_px, 0.3 AS recheck_score, 0.8 AS ng_score FROM b""")
def _(t):
    mapped = bx.map_bbox(["rx0", "ry0", "rx1", "ry1"], [100, 200, 150, 230])
    rows = boxes(t).select("image_id", *[c.alias(n) for c, n in zip(mapped, ("x0", "y0", "x1", "y1"))], R("score"))
    return rows.select("*", bx.bbox_area("x0", "y0", "x1", "y1").alias("area_px"), F.lit(0.3).alias("recheck_score"), F.lit(0.8).alias("ng_score"))


HALVES = """
WITH r AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) AS n, count(*) OVER () // 2 AS half FROM v_bank),
lo AS (SELECT * FROM r WHERE n <= half), hi AS (SELECT *, n - half - 1 AS draw FROM r WHERE n > half AND n <= 2 * half),
dist AS (SELECT hi.vec_id, hi.draw, min({0}) AS distance FROM hi CROSS JOIN lo GROUP BY 1, 2)""".format(DIST.format("hi", "lo"))
THRESHOLDS = HALVES + """,
s AS (SELECT count(*) AS n, avg(distance) AS mean FROM dist),
im AS (SELECT i, max(distance) AS peak FROM (SELECT i, ('0x' || substr(md5('42|' || i || '|' || j), 1, 8))::bigint % s.n AS draw FROM s, (SELECT unnest(range(100)) AS i), (SELECT unnest(range(64)) AS j) WHERE i < s.n) JOIN dist USING (draw) GROUP BY i),
p AS (SELECT avg(peak) AS p99, stddev_pop(peak) AS std FROM im),
sc AS (SELECT least(greatest(tanh((peak - mean) / (2 * greatest(p99 - mean, 1e-6))), 0.0), 1.0) AS score FROM im, p, s),
th AS (SELECT (SELECT mean FROM s) AS distance_mean, (SELECT p99 FROM p) AS distance_p99, (SELECT std FROM p) AS distance_std, quantile_cont(score, 0.99) AS recheck_score,
  greatest(quantile_cont(score, 0.99), quantile_cont(score, 0.999)) AS ng_score FROM sc)"""


@query("agg_calibrate_distances", HALVES + " SELECT vec_id, draw, round(distance, 6) AS distance FROM dist")
def _(t):
    return an.calibrate_distances(t.bank).select("vec_id", "draw", R("distance"))


def thresholds(t):
    return an.calibrate_thresholds(an.calibrate_distances(t.bank), 64, 100)


STATS = ["distance_mean", "distance_p99", "distance_std", "recheck_score", "ng_score"]


@query("agg_calibrate_thresholds", THRESHOLDS + " SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in STATS) + " FROM th")
def _(t):
    return thresholds(t).select(*[R(c) for c in STATS])


@query("job_score_embeddings", THRESHOLDS + f""",
n AS (SELECT q.vec_id, min({DIST.format('q', 'b')}) AS distance FROM v_queries q CROSS JOIN v_bank b GROUP BY 1),
x AS (SELECT least(greatest(tanh((distance - distance_mean) / (2 * greatest(distance_p99 - distance_mean, 1e-6))), 0.0), 1.0) AS score, recheck_score, ng_score FROM n, th)
SELECT CASE WHEN score >= ng_score THEN 'NG' WHEN score >= recheck_score THEN 'RECHECK' ELSE 'OK' END AS decision, count(*) AS jobs FROM x GROUP BY 1""")
def _(t):
    from inspectlake.plans.jobs import score_embeddings

    return score_embeddings(t.queries, t.bank, 64, 100).groupBy("decision").agg(F.count("*").alias("jobs"))


@query("agg_coreset_stride", "SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM v_bank) WHERE r IN (SELECT floor(i * (c / ceil(c * 0.3))) FROM (SELECT unnest(range(cast(ceil(c * 0.3) AS bigint))) AS i, c FROM (SELECT count(*) AS c FROM v_bank)))")
def _(t):
    return an.coreset_stride(t.bank, 0.3).select("vec_id")


@query("agg_coreset_greedy")
def _(t):
    return an.coreset_greedy(t.bank, 0.2).select("vec_id", "pick")


@query("agg_vector_mean", "SELECT pos, round(avg(e), 6) AS mean, count(*) AS count FROM (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding)::double AS e FROM embeddings) GROUP BY 1")
def _(t):
    return an.vector_mean(t.embeddings).select("pos", R("mean"), "count")


@query("agg_pca_scatter", """
WITH u AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::double AS e FROM embeddings), m AS (SELECT i, avg(e) AS mean FROM u GROUP BY i), c AS (SELECT vec_id, i, e - mean AS d FROM u JOIN m USING (i))
SELECT a.i AS i, b.i AS j, round(sum(a.d * b.d), 5) AS value FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2""")
def _(t):
    scatter = an.scatter_matrix(t.embeddings)[0]
    return scatter.select("i", F.posexplode("values").alias("j", "v")).select("i", "j", F.round("v", 5).alias("value"))


@query("agg_pca_fit")
def _(t):
    return an.fit_pca(t.embeddings, 8, "v1").select("component", F.round("explained_ratio", 6).alias("explained_ratio"), "weights")


FIXED = [[((i * 7 + j * 3) % 11 - 5) / 10.0 for j in range(64)] for i in range(4)]


@query("agg_pca_project", """
SELECT vec_id, i AS component, round(list_sum(list_transform(embedding, lambda v, j: (v::double - 0.01) * (((i * 7 + (j - 1) * 3) % 11 - 5) / 10.0::double))), 6) AS value
FROM embeddings, (SELECT unnest(range(4)) AS i)""")
def _(t):
    rows = an.pca_project(t.embeddings, FIXED, [0.01] * 64)
    return rows.select("vec_id", F.posexplode("embedding").alias("component", "v")).select("vec_id", "component", F.round("v", 6).alias("value"))


@query("prj_patch_rows", """
SELECT vec_id, cast(i // 4 AS int) AS patch_row, i % 4 AS patch_col, round(list_sum(embedding[i * 4 + 1:i * 4 + 4]::double[]), 6) AS total FROM embeddings, (SELECT unnest(range(16)) AS i)""")
def _(t):
    grid = t.embeddings.withColumn("patches", F.expr("transform(sequence(0, 15), i -> slice(embedding, i * 4 + 1, 4))"))
    rows = an.patch_rows(grid, "patches", 4, ["vec_id"])
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("vec_id", "patch_row", "patch_col", F.round(total, 6).alias("total"))
