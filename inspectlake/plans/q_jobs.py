"""Queries of whole jobs, sinks, models and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inspectlake.operators import anomaly as an, datasets as ds, fusion as fu, models as md
from inspectlake.plans import jobs, q_quality
from inspectlake.plans.q_anomaly import DIST, STATS, R
from inspectlake.plans.q_fusion import MATCH
from inspectlake.plans.q_events import MANUAL_SQL
from inspectlake.plans.q_health import KINDS, PRESENCE_SQL, STATE_SQL, TIMEOUT_SQL
from inspectlake.plans.registry import query
from inspectlake.plans.views import BASE_TABLES, Tables
from inspectlake.sinks import tables as sk
from inspectlake.streaming import streams as st

CUBE = ["sequence_id", "camera_id"]


class StreamTables(Tables):
    """The same tables and views, read as streams."""

    def __getattr__(self, name):
        if name in BASE_TABLES and name not in self._cache:
            schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
            # The pattern lets a table be one file or a folder of files.
            self._cache[name] = self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")
        return super().__getattr__(name)


def streamed(t, name, time_us="ts_us", delay="10 minutes"):
    rows = getattr(StreamTables(t.spark, t.folder), name)
    return rows.withColumn("event_time", F.timestamp_micros(time_us)).withWatermark("event_time", delay)


# --- streams -----------------------------------------------------------------------------------


@query("str_ingest", """SELECT sequence_id, CASE WHEN sequence_id % 11 IN (2, 3) THEN 'RECHECK' ELSE decision END AS decision, cast(floor(ts_us / 1000) AS bigint) AS timestamp_ms FROM v_event_lines WHERE sequence_id % 50 NOT IN (3, 4, 5, 6)""")
def _(t):
    events = st.parse_detection_events(StreamTables(t.spark, t.folder).event_lines.select("value"))
    return st.to_table(events.select("sequence_id", "decision", "timestamp_ms"), "ingest").select("sequence_id", "decision", "timestamp_ms")


@query("str_dedupe", "SELECT station_id, sequence_id, decision FROM v_results")
def _(t):
    rows = streamed(t, "results").select("station_id", "sequence_id", "trigger_id", "seat_id", "decision", "event_time")
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = st.to_table(st.dedupe(twice, ["station_id", "sequence_id", "trigger_id", "seat_id"]), "dedupe")
    return out.select("station_id", "sequence_id", "decision")


@query("str_counts", """SELECT station_id, epoch_us(date_trunc('hour', make_timestamp(ts_us))) AS hour_us, count(*) AS total, count_if(decision = 'OK') AS ok, count_if(decision = 'NG') AS ng, count_if(decision = 'RECHECK') AS recheck, count_if(decision = 'ERROR') AS error FROM v_results GROUP BY 1, 2""")
def _(t):
    rows = st.to_table(st.hourly_counts(streamed(t, "results"), ["station_id"]), "counts", "update")
    last = st.newest_updates(rows, ["station_id", "hour_start"])
    return last.select("station_id", F.unix_micros("hour_start").alias("hour_us"), "total", "ok", "ng", "recheck", "error")


@query("str_tact", """SELECT recipe_id, (ts_us // 10000000 + k) * 10000000 AS end_us, count(*) AS results FROM v_results, (SELECT unnest(range(1, 7)) AS k) GROUP BY 1, 2""")
def _(t):
    rows = st.to_table(st.tact_windows(streamed(t, "results"), ["recipe_id"]), "tact", "update")
    return st.newest_updates(rows, ["recipe_id", "window_end"]).select("recipe_id", F.unix_micros("window_end").alias("end_us"), "results")


@query("str_health", STATE_SQL)
def _(t):
    rows = StreamTables(t.spark, t.folder).select(KINDS)
    folder = sk.fresh_folder(t.spark, "health")
    st.run_health(rows, folder, ["station_id"], ["ts_us", "sequence_id"], 2, 3).awaitTermination()
    return t.spark.read.parquet(f"{folder}/events").select("station_id", "sequence_id", "alarm_level", "station_state")


@query("str_presence", PRESENCE_SQL)
def _(t):
    folder = sk.fresh_folder(t.spark, "presence")
    rows = StreamTables(t.spark, t.folder).readings
    st.run_presence(rows, folder, ["sensor_id"], ["ts_us", "event_id"], 260, 200, 172_800_000).awaitTermination()
    state = sk.newest_version(t.spark, f"{folder}/state")
    return state.select("sensor_id", "present_us", "distance_mm", F.when(F.col("reported"), "present").otherwise("timeout").alias("outcome"))


@query("str_sessions")
def _(t):
    frames = streamed(t, "results").select("recipe_id", "event_time", F.col("seat_id").alias("light_id"))
    return st.to_table(st.idle_sessions(frames, ["recipe_id"], "5 minutes"), "sessions").drop("version")


def closing(t):
    """One row far in the future, which settles everything that the tables leave open."""
    return StreamTables(t.spark, t.folder).region.where("r_regionkey = 0").select(F.lit(4_102_444_800_000_000).alias("at_us"))


@query("str_result_timeout", TIMEOUT_SQL)
def _(t):
    rows = StreamTables(t.spark, t.folder)
    return st.to_table(st.result_timeouts(rows.jobs, rows.replies, ["station_id", "sequence_id"], ticks=closing(t)), "timeouts").drop("version")


@query("str_manual_match", MANUAL_SQL)
def _(t):
    rows = StreamTables(t.spark, t.folder)
    return st.to_table(st.manual_matches(rows.requests, rows.seats, ["station_id"], 30 * 86400, ticks=closing(t)), "manual").drop("version")


@query("str_latest", """SELECT station_id, sequence_id, decision FROM v_results QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ts_us DESC, sequence_id DESC) = 1""")
def _(t):
    rows = StreamTables(t.spark, t.folder).results.select(
        "station_id", "sequence_id", "trigger_id", F.col("ts_us").alias("timestamp_ms"), "decision", F.lit(0).alias("revision"), F.lit(False).alias("enrichment"))
    folder = sk.fresh_folder(t.spark, "latest")
    st.run_latest(rows, folder).awaitTermination()
    return sk.newest_version(t.spark, f"{folder}/state").select("station_id", "sequence_id", "decision")


@query("str_training_collect", "SELECT sample_id, camera_id, decision FROM v_manifest WHERE decision = 'NG'")
def _(t):
    folder = sk.fresh_folder(t.spark, "collect")
    st.run_collect(StreamTables(t.spark, t.folder).manifest, folder, "NG").awaitTermination()
    return t.spark.read.parquet(f"{folder}/samples").select("sample_id", "camera_id", "decision")


@query("str_quality_gate", """
SELECT sequence_id, camera_id, pose, count(*) AS frames, count_if(pixel_format <> 'MONO8') AS failed, array_to_string(list_filter(['DIFFUSE', 'POLAR_DIFFUSE', 'HIGH_LEFT'], lambda l: NOT list_contains(list(light_id), l)), '|') AS missing,
  bool_and(pixel_format = 'MONO8') AND count(DISTINCT light_id) FILTER (light_id IN ('DIFFUSE', 'POLAR_DIFFUSE', 'HIGH_LEFT')) = 3 AS quality_pass
FROM (SELECT *, CASE WHEN pose_id = '' THEN camera_id ELSE pose_id END AS pose FROM v_frames) GROUP BY sequence_id, camera_id, pose""")
def _(t):
    pose = F.when(F.col("pose_id") == "", F.col("camera_id")).otherwise(F.col("pose_id"))
    frames = StreamTables(t.spark, t.folder).frames.select("sequence_id", "camera_id", pose.alias("pose"), "light_id", (F.col("pixel_format") == "MONO8").alias("passed"), F.col("timestamp_us").alias("at_us"))
    rows = st.to_table(st.quality_gate(frames, ["sequence_id", "camera_id", "pose"], ["DIFFUSE", "POLAR_DIFFUSE", "HIGH_LEFT"], ticks=closing(t)), "gate")
    return rows.drop("version").withColumn("missing", F.array_join("missing", "|"))


# --- sinks -------------------------------------------------------------------------------------


@query("snk_event_append", "SELECT sequence_id, decision FROM v_results")
def _(t):
    path = sk.fresh_folder(t.spark, "events")
    events = StreamTables(t.spark, t.folder).results.select("sequence_id", "decision")
    sk.append_stream(events, f"{path}/lines", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.schema("sequence_id long, decision string").json(f"{path}/lines")


@query("snk_latest", """SELECT station_id, sequence_id, CASE WHEN sequence_id % 2 = 0 THEN 1 ELSE 0 END AS revision FROM v_results QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ts_us DESC, sequence_id DESC) = 1""")
def _(t):
    base = t.results.select("station_id", "sequence_id", "trigger_id", F.col("ts_us").alias("timestamp_ms"), F.lit(0).alias("revision"), F.lit(False).alias("enrichment"))
    richer = base.where("sequence_id % 2 = 0").withColumns({"revision": F.lit(1), "enrichment": F.lit(True)})
    stray = base.withColumns({"revision": F.lit(2), "enrichment": F.lit(True), "timestamp_ms": F.col("timestamp_ms") + 1})
    path = sk.fresh_folder(t.spark, "latest")
    sk.write_version(sk.merge_latest(None, base.unionByName(richer).unionByName(stray)), path, 0)
    return sk.newest_version(t.spark, path).select("station_id", "sequence_id", "revision")


@query("snk_result_partitioned", "SELECT recipe_id, cast(strftime(make_timestamp(ts_us), '%Y%m%d') AS int) AS day, count(*) AS results FROM v_results GROUP BY 1, 2")
def _(t):
    path = sk.fresh_folder(t.spark, "results")
    sk.write_by_day(t.results.select("recipe_id", "sequence_id", "ts_us", "decision"), path, station="recipe_id")
    return t.spark.read.parquet(path).groupBy("recipe_id", F.col("day").cast("int").alias("day")).agg(F.count("*").alias("results"))


@query("snk_diagnostics", "SELECT 'quality' AS report, count(*) AS rows FROM v_frames UNION ALL SELECT 'timings', count(*) FROM v_timings")
def _(t):
    path = sk.fresh_folder(t.spark, "diagnostics")
    sk.write_diagnostics({"quality": t.frames, "timings": t.timings}, path)
    count = lambda n: t.spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("report"), F.count("*").alias("rows"))
    return count("quality").union(count("timings"))


@query("snk_raw_frames", "SELECT sequence_id, camera_id, light_id, frame_index FROM v_frames")
def _(t):
    path = sk.fresh_folder(t.spark, "raw")
    sk.append_events(sk.raw_frame_rows(t.frames), path)
    return t.spark.read.schema("sequence_id long, camera_id string, light_id string, frame_index int").json(path)


@query("snk_manifest", """
SELECT 'manifest' AS part, sample_id AS name, camera_id || '/' || pose_id || '/' || split || '/' || has_defect AS detail FROM v_manifest UNION ALL SELECT 'skipped', frame_id::varchar, light_id FROM v_frames WHERE light_id = 'BAR_LEFT'
UNION ALL SELECT 'summary', 'lines', (1 + (SELECT count(DISTINCT decision) + count(DISTINCT camera_id) + count(DISTINCT label_status) FROM v_manifest))::varchar""")
def _(t):
    path = sk.fresh_folder(t.spark, "manifest")
    sk.write_manifest(t.manifest, ds.dataset_summary(t.manifest), t.frames.where("light_id = 'BAR_LEFT'").select("frame_id", "light_id"), path)
    read = lambda name, schema: t.spark.read.schema(schema).json(f"{path}/{name}")
    rows = read("manifest", "sample_id string, camera_id string, pose_id string, split string, has_defect boolean")
    rows = rows.select(F.lit("manifest").alias("part"), F.col("sample_id").alias("name"), F.concat_ws("/", "camera_id", "pose_id", "split", F.col("has_defect").cast("string")).alias("detail"))
    skipped = read("skipped", "frame_id long, light_id string").select(F.lit("skipped"), F.col("frame_id").cast("string"), "light_id")
    return rows.union(skipped).union(t.spark.read.text(f"{path}/summary").agg(F.lit("summary"), F.lit("lines"), F.count("*").cast("string")))


@query("snk_model_assets", """
SELECT 'asset' AS kind, 'bank' AS name, (SELECT count(*) FROM v_bank) AS rows, true AS intact, true AS has_pca UNION ALL SELECT 'asset', 'thresholds', 1, true, true UNION ALL SELECT 'asset', 'pca', 4, true, true
UNION ALL SELECT 'input', 'samples', (SELECT count(*) FROM embeddings), NULL, true""")
def _(t):
    path = sk.fresh_folder(t.spark, "assets")
    thresholds = an.calibrate_thresholds(an.calibrate_distances(t.bank), 64, 100)
    folder = sk.write_model_assets("v1", t.bank, thresholds, an.fit_pca(t.bank, 4, "v1"), path, inputs={"samples": t.embeddings})
    return sk.asset_contract(t.spark, folder).select("kind", "name", "rows", "intact", "has_pca")


@query("snk_eval_report", MATCH + " SELECT count(*) AS images, sum(true_positives) AS tp FROM e")
def _(t):
    path = sk.fresh_folder(t.spark, "evaluation")
    counts = fu.match_detections(t.candidates, t.truth, CUBE, ["ordinal"], 0.5, 0.2)
    sk.write_evaluation(fu.evaluation_totals(counts, ["camera_id"]), counts, path)
    stored = t.spark.read.schema("sequence_id long, camera_id string, true_positives long").json(f"{path}/images")
    return stored.agg(F.count("*").alias("images"), F.sum("true_positives").alias("tp"))


@query("snk_review_snapshot", """
WITH m AS (SELECT station_id, review_id, max(ts_us) AS marked_us FROM v_actions WHERE action = 'mark_review' GROUP BY ALL)
SELECT 'queue' AS part, station_id, review_id AS id, marked_us AS us FROM m WHERE NOT EXISTS (SELECT 1 FROM v_actions a WHERE a.station_id = m.station_id AND a.review_id = m.review_id AND a.action IN ('review_confirm_defect','review_dismiss_as_ok') AND a.ts_us >= m.marked_us)
UNION ALL SELECT 'action', station_id, action_id, ts_us FROM v_actions""")
def _(t):
    from inspectlake.operators.events import review_queue

    path = sk.fresh_folder(t.spark, "reviews")
    # The first version holds part of the day only; the second replaces the queue and adds its own actions.
    noon = t.actions.agg(F.percentile("ts_us", F.lit(0.5))).first()[0] or 0
    early, late = t.actions.where(F.col("ts_us") <= noon), t.actions.where(F.col("ts_us") > noon)
    for version, (known, fresh) in enumerate(((early, early), (t.actions, late))):
        sk.write_reviews(review_queue(known, ["station_id", "review_id"]), fresh, path, version)
    queue = sk.newest_version(t.spark, f"{path}/queue").select(F.lit("queue").alias("part"), "station_id", F.col("review_id").alias("id"), F.col("marked_us").alias("us"))
    return queue.union(t.spark.read.parquet(f"{path}/actions").select(F.lit("action"), "station_id", "action_id", "ts_us"))


@query("src_images", "SELECT vec_id AS frame_id, 8 AS width, 8 AS height, 64 AS bytes FROM embeddings")
def _(t):
    return q_quality.frame_images(t).select("frame_id", "width", "height", F.length("image").alias("bytes"))


# --- models ------------------------------------------------------------------------------------


def tensors(t):
    return t.embeddings.select("vec_id", F.col("embedding").alias("values"), F.array(F.lit(1), F.lit(8), F.lit(8)).alias("shape"), F.when(F.col("label") < 4, "mean").when(F.col("label") < 7, "gone").otherwise("none").alias("model_key"))


def mean_model():
    return lambda batch: np.stack([batch.reshape(len(batch), -1).mean(1), batch.reshape(len(batch), -1).max(1)], axis=1)


def missing_model():
    raise md.AssetUnavailable("model file")


@query("udf_embed", "SELECT vec_id, round(list_avg(embedding::double[]), 5) AS mean, round(list_max(embedding)::double, 5) AS peak, 0 AS error_code FROM embeddings")
def _(t):
    out = md.embed(tensors(t), ["vec_id"], lambda: mean_model(), 2)
    return out.select("vec_id", F.round(F.col("embedding")[0], 5).alias("mean"), F.round(F.col("embedding")[1], 5).alias("peak"), "error_code")


def pooled_model():
    """Two layers: means and maxima of 2 x 2 pixels, means of 4 x 4 pixels."""

    def run(batch):
        image = batch.reshape(len(batch), 8, 8).astype(np.float64)
        squares = lambda n: image.reshape(len(batch), 8 // n, n, 8 // n, n)
        return [np.stack([squares(2).mean((2, 4)), squares(2).max((2, 4))], axis=1), squares(4).mean((2, 4))[:, None]]

    return run


@query("udf_embed_layers", """
WITH p AS (SELECT vec_id, pos // 8 AS y, pos % 8 AS x, e::double AS v FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS e FROM embeddings)),
a AS (SELECT vec_id, y // 2 AS r, x // 2 AS c, avg(v) AS mean, max(v) AS peak FROM p GROUP BY ALL), b AS (SELECT vec_id, y // 4 AS r, x // 4 AS c, avg(v) AS mean FROM p GROUP BY ALL)
SELECT a.vec_id, i AS patch_row, j AS patch_col, round(a.mean, 6) AS e0, round(a.peak, 6) AS e1, round(b.mean, 6) AS e2, 3 AS dim
FROM (SELECT unnest(range(4)) AS i) x, (SELECT unnest(range(3)) AS j) y, a JOIN b ON b.vec_id = a.vec_id WHERE a.r = i AND a.c = j * 4 // 3 AND b.r = i * 2 // 4 AND b.c = j * 2 // 3""")
def _(t):
    grid, _failed = md.spatial_embeddings(tensors(t), ["vec_id"], lambda: pooled_model(), ["fine", "coarse"], 4, 3)
    part = lambda i: F.round(F.col("embedding")[i], 6).alias(f"e{i}")
    return grid.select("vec_id", "patch_row", "patch_col", part(0), part(1), part(2), F.size("embedding").alias("dim"))


@query("udf_detect", "SELECT vec_id, i AS row, round(embedding[i * 8 + 1]::double, 5) AS first FROM embeddings, (SELECT unnest(range(8)) AS i)")
def _(t):
    rows = md.detect(tensors(t), ["vec_id"], lambda: (lambda batch: batch.reshape(len(batch), -1)), 8)
    return rows.select("vec_id", "row", F.round(F.col("raw")[0], 5).alias("first"))


@query("udf_route", """SELECT vec_id, CASE WHEN label < 4 THEN 0 WHEN label < 7 THEN 13 ELSE 9 END AS error_code, CASE WHEN label < 4 THEN '' WHEN label < 7 THEN 'RECHECK' ELSE 'ERROR' END AS failed_decision, label BETWEEN 4 AND 6 AS collect_sample FROM embeddings""")
def _(t):
    backends = {"mean": lambda df: md.apply_model(df, ["vec_id"], lambda: mean_model(), 2), "gone": lambda df: md.apply_model(df, ["vec_id"], missing_model)}
    return md.route(tensors(t), ["vec_id"], backends).select("vec_id", "error_code", F.coalesce("failed_decision", F.lit("")).alias("failed_decision"), "collect_sample")


# --- whole jobs --------------------------------------------------------------------------------

# Dimensions of the inspection: recipes with their limits, views, regions, models, channels and matrices.
RECIPES = [
    # recipe, method, fallback light, least mean grey, largest difference of light means, thresholds, largest candidates
    ("k0", "SKU1", "ecc", "DIFFUSE", 10.0, 12.0, 0.55, 0.8, 16), ("k1", "SKU1", "fixed_calibration", "DIFFUSE", 121.0, 80.0, 0.55, 0.8, 16),
    ("k2", "SKU1", "fixed_calibration", "DIFFUSE", 10.0, 80.0, 0.7, 0.9, 16), ("k3", "SKU1", "fixed_calibration", "DIFFUSE", 10.0, 80.0, 0.55, 0.8, 16),
    ("k4", "SKU1", "fixed_calibration", "DIFFUSE", 10.0, 80.0, 0.55, 0.8, 16), ("k5", "SKU1", "fixed_calibration", "DIFFUSE", 10.0, 80.0, 0.55, 0.8, 16),
]
INSPECT_VIEWS = [
    ("k0", "CAM_A", "", "m_a", "m_net", "DIFFUSE", "t_a"), ("k0", "CAM_B", "CAM_B", "m_b", "", "POLAR_DIFFUSE", "t_b"), ("k1", "CAM_A", "", "m_a", "", "HIGH_LEFT", "t_a"), ("k1", "CAM_B", "", "m_b", "m_net", "GONE", "t_b"),
    ("k2", "CAM_A", "CAM_A", "m_a", "", "DIFFUSE", "t_a"), ("k2", "CAM_B", "P2", "m_b", "m_net", "DIFFUSE", "t_b"), ("k3", "CAM_A", "", "m_a", "", "DIFFUSE", "t_a"), ("k3", "CAM_B", "", "m_b", "", "DIFFUSE", "t_wide"),
    ("k4", "CAM_A", "", "m_a", "", "DIFFUSE", "t_a"), ("k4", "CAM_B", "", "m_gone", "", "DIFFUSE", "t_b"), ("k5", "CAM_A", "", "m_low", "", "DIFFUSE", "t_a"), ("k5", "CAM_B", "", "m_b", "", "DIFFUSE", "t_b"),
]
INSPECT_ROIS = [("t_a", "seat", 1, 1, 6, 5), ("t_a", "edge", 0, 4, 7, 7), ("t_b", "seat", 2, 0, 7, 6), ("t_wide", "wide", 0, 0, 9, 3)]
MODELS = [("m_a", 0.055, 0.085, 0.3, 0.6), ("m_b", 0.06, 0.09, 0.35, 0.7), ("m_net", 0.06, 0.1, None, None), ("m_low", 0.06, 0.1, 0.5, 0.9), ("m_gone", None, None, 0.5, 0.9)]
INPUTS = [
    ("m_a", 0, "ch0_diffuse"), ("m_a", 1, "aux_specular_removed"), ("m_b", 0, "light:HIGH_LEFT"), ("m_b", 1, "max_min:DIFFUSE:POLAR_DIFFUSE:HIGH_LEFT"), ("m_net", 0, "light:POLAR_DIFFUSE"), ("m_net", 1, "local_contrast:DIFFUSE"),
    ("m_low", 0, "light:LOW_LEFT"), ("m_gone", 0, "light:DIFFUSE"),
]
_ID = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
MATRICES = [(c, light, [1.0, 0.0, 0.5 if light == "POLAR_DIFFUSE" else 0.0, *_ID[3:]]) for c in ("cal1", "cal_old") for light in ("DIFFUSE", "POLAR_DIFFUSE", "HIGH_LEFT")]


def _sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)


INSPECT_SQL = f"""
WITH rc(recipe_id, recipe_sku, method, fallback, min_grey, max_delta, r_recheck, r_ng, cap) AS (VALUES {_sql_rows(RECIPES)}),
vw AS (SELECT recipe_id, camera_id, CASE WHEN p = '' THEN camera_id ELSE p END AS pose, model_key, net, base, tpl FROM (VALUES {_sql_rows(INSPECT_VIEWS)}) x(recipe_id, camera_id, p, model_key, net, base, tpl)),
ro(tpl, roi_name, rx0, ry0, rx1, ry1) AS (VALUES {_sql_rows(INSPECT_ROIS)}), md(model_key, mean, p99, m_recheck, m_ng) AS (VALUES {_sql_rows(MODELS)}),
sp(model_key, pos, op, need, light_id) AS (VALUES ('m_a', 0, 'light', 1, 'DIFFUSE'), ('m_a', 1, 'spread', 2, 'DIFFUSE'), ('m_a', 1, 'spread', 2, 'POLAR_DIFFUSE'), ('m_b', 0, 'light', 1, 'HIGH_LEFT'), ('m_b', 1, 'spread', 3, 'DIFFUSE'), ('m_b', 1, 'spread', 3, 'POLAR_DIFFUSE'),
  ('m_b', 1, 'spread', 3, 'HIGH_LEFT'), ('m_net', 0, 'light', 1, 'POLAR_DIFFUSE'), ('m_net', 1, 'contrast', 1, 'DIFFUSE')),
gy AS (SELECT frame_id, avg(v) AS grey FROM v_pixels GROUP BY 1),
f AS (SELECT i.*, CASE WHEN pose_id = '' THEN camera_id ELSE pose_id END AS pose, grey, grey >= min_grey AND pixel_format = 'MONO8' AS fine, max_delta, method, fallback FROM v_inspect_frames i JOIN gy USING (frame_id) JOIN rc USING (recipe_id)),
w AS (SELECT *, timestamp_us < lag(timestamp_us) OVER (PARTITION BY sequence_id, camera_id ORDER BY light_seq_index) AS falling FROM f),
b AS (SELECT sequence_id, recipe_id, camera_id, count(*) = 3 AND bool_and(fine AND light_id <> 'BAR_LEFT' AND sku = 'SKU1' AND shot_id <> 0) AND NOT bool_or(coalesce(falling, false)) AND max(robot_x) = min(robot_x)
  AND max(grey) - min(grey) <= any_value(max_delta) AS good FROM w GROUP BY ALL),
j AS (SELECT sequence_id, recipe_id, count(*) = 2 AND bool_and(good) AS gate FROM b GROUP BY ALL),
broken AS (SELECT DISTINCT sequence_id FROM f JOIN vw USING (recipe_id, camera_id, pose) JOIN ro USING (tpl) WHERE calibration_id <> 'cal1' OR rx1 >= 8),
p AS (SELECT f.sequence_id, f.recipe_id, f.camera_id, f.pose, light_id, roi_name, method, CASE WHEN base IN ('DIFFUSE', 'POLAR_DIFFUSE', 'HIGH_LEFT') THEN base ELSE fallback END AS base, x - rx0 AS x, y - ry0 AS y, rx1 - rx0 AS mx, ry1 - ry0 AS my, v
  FROM f JOIN vw USING (recipe_id, camera_id, pose) JOIN ro USING (tpl) JOIN v_pixels px ON px.frame_id = f.frame_id AND x BETWEEN rx0 AND rx1 AND y BETWEEN ry0 AND ry1 WHERE rx1 < 8 AND f.sequence_id IN (SELECT sequence_id FROM j WHERE gate)),
o AS (SELECT dx, dy, greatest(abs(dx), abs(dy)) AS ring FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
s AS (SELECT m.sequence_id, m.camera_id, m.roi_name, m.light_id, dx, dy, ring, count(*) AS n, sum(a.v)::double AS sa, sum(m.v)::double AS sb, sum(a.v * a.v)::double AS saa, sum(m.v * m.v)::double AS sbb, sum(a.v * m.v)::double AS sab
  FROM p a JOIN p m ON m.sequence_id = a.sequence_id AND m.camera_id = a.camera_id AND m.roi_name = a.roi_name AND a.light_id = a.base AND m.light_id <> m.base AND a.method = 'ecc' CROSS JOIN o WHERE m.x = a.x + dx AND m.y = a.y + dy GROUP BY ALL),
al AS (SELECT *, (sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)) AS corr FROM s QUALIFY row_number() OVER (PARTITION BY sequence_id, camera_id, roi_name, light_id ORDER BY corr DESC, ring, dy, dx) = 1),
unaligned AS (SELECT DISTINCT sequence_id FROM al WHERE corr < 0.02 OR sqrt(dx * dx + dy * dy) > 3.0),
z AS (SELECT p.sequence_id, p.recipe_id, p.camera_id, p.pose, p.roi_name, p.light_id, p.x, p.y, q.v FROM p LEFT JOIN al ON al.sequence_id = p.sequence_id AND al.camera_id = p.camera_id AND al.roi_name = p.roi_name AND al.light_id = p.light_id
  JOIN p q ON q.sequence_id = p.sequence_id AND q.camera_id = p.camera_id AND q.roi_name = p.roi_name AND q.light_id = p.light_id AND q.x = greatest(0, least(p.mx, p.x + coalesce(dx, 0))) AND q.y = greatest(0, least(p.my, p.y + coalesce(dy, 0)))),
rt AS (SELECT recipe_id, camera_id, pose, roi_name, CASE WHEN recipe_id = 'k0' AND camera_id = 'CAM_A' AND roi_name = 'edge' THEN 'm_b' ELSE model_key END AS model_key, 'primary' AS role FROM vw JOIN ro USING (tpl)
  UNION ALL SELECT recipe_id, camera_id, pose, roi_name, net, 'safety_net' FROM vw JOIN ro USING (tpl) WHERE net <> ''),
lm AS (SELECT sequence_id, camera_id, roi_name, light_id, floor(avg(v)) AS mean FROM z GROUP BY ALL),
ch AS (SELECT z.sequence_id, z.recipe_id, z.camera_id, z.roi_name, rt.model_key, rt.role, sp.pos, z.x, z.y, CASE any_value(op) WHEN 'light' THEN max(v) WHEN 'contrast' THEN abs(max(v) - max(lm.mean)) ELSE max(v) - min(v) END / 255.0 AS value
  FROM z JOIN rt USING (recipe_id, camera_id, pose, roi_name) JOIN sp ON sp.model_key = rt.model_key AND sp.light_id = z.light_id JOIN lm ON lm.sequence_id = z.sequence_id AND lm.camera_id = z.camera_id AND lm.roi_name = z.roi_name AND lm.light_id = z.light_id GROUP BY ALL),
st AS (SELECT sequence_id, recipe_id, camera_id, roi_name, model_key, role, pos, avg(value) AS m, stddev_pop(value) AS d FROM ch GROUP BY ALL),
ve AS (SELECT sequence_id, recipe_id, camera_id, roi_name, model_key, role, max(m) FILTER (pos = 0) AS e0, max(d) FILTER (pos = 0) AS e1, max(m) FILTER (pos = 1) AS e2, max(d) FILTER (pos = 1) AS e3 FROM st GROUP BY ALL),
di AS (SELECT ve.sequence_id, ve.recipe_id, ve.camera_id, ve.roi_name, ve.model_key, ve.role, min(sqrt((e0 - embedding[1]) ** 2 + (e1 - embedding[2]) ** 2 + (e2 - embedding[3]) ** 2 + (e3 - embedding[4]) ** 2)) AS distance FROM ve JOIN v_inspect_bank k ON k.model_key = ve.model_key GROUP BY ALL),
sc AS (SELECT di.*, least(greatest(tanh((distance - mean) / (2 * greatest(p99 - mean, 1e-6))), 0.0), 1.0) AS score, coalesce(m_recheck, r_recheck) AS recheck, coalesce(m_ng, r_ng) AS ng FROM di JOIN md USING (model_key) JOIN rc USING (recipe_id)),
tp AS (SELECT * FROM sc WHERE score >= recheck QUALIFY row_number() OVER (PARTITION BY sequence_id, camera_id, roi_name ORDER BY score DESC, role) = 1),
dc AS (SELECT sequence_id, count_if(score >= ng) AS ng, count(*) AS found FROM tp GROUP BY 1),
e AS (SELECT j.sequence_id, CASE WHEN NOT gate THEN 'gate' WHEN b.sequence_id IS NOT NULL THEN 'broken' WHEN u.sequence_id IS NOT NULL THEN 'gate' WHEN recipe_id = 'k5' THEN 'broken' WHEN recipe_id = 'k4' THEN 'asset' ELSE '' END AS ending, coalesce(dc.ng, 0) AS ng, coalesce(found, 0) AS found
  FROM j LEFT JOIN broken b USING (sequence_id) LEFT JOIN unaligned u USING (sequence_id) LEFT JOIN dc USING (sequence_id))
SELECT sequence_id, CASE WHEN ending = 'broken' THEN 'ERROR' WHEN ending <> '' THEN 'RECHECK' WHEN ng > 0 THEN 'NG' WHEN found > 0 THEN 'RECHECK' ELSE 'OK' END AS decision, CASE ending WHEN 'gate' THEN 7 WHEN 'broken' THEN 9 WHEN 'asset' THEN 13 ELSE 0 END AS error_code,
  ending IN ('', 'asset') AS quality_pass, CASE WHEN ending = '' THEN found ELSE 0 END AS defect_count FROM e"""


@query("job_inspect", INSPECT_SQL)
def _(t):
    recipes = t.values(RECIPES, "recipe_id string, recipe_sku string, method string, fallback_light_id string, min_mean_gray double, max_light_mean_delta double, recheck_score double, ng_score double, max_candidates_per_roi int")
    loose = {"max_saturation_ratio": 0.5, "max_dark_ratio": 0.5, "max_mean_gray": 250.0, "min_sharpness": 0.5, "min_motion_gradient": 0.5, "max_capture_span_us": 1000, "max_pose_delta": 0.5, "search_radius_px": 1, "max_registration_error_px": 3.0, "min_correlation": 0.02}
    recipes = recipes.withColumns({k: F.lit(v) for k, v in loose.items()})
    views = t.values(INSPECT_VIEWS, "recipe_id string, camera_id string, pose_id string, model_key string, safety_net_key string, view_base_light string, roi_template string")
    views = views.withColumns({"want_calibration": F.lit("cal1"), "image_w": F.lit(8), "image_h": F.lit(8)})
    lights = t.values([(r[0], i, name, True) for r in RECIPES for i, name in enumerate(("DIFFUSE", "POLAR_DIFFUSE", "HIGH_LEFT"))], "recipe_id string, pos int, light_id string, required boolean")
    rois = t.values(INSPECT_ROIS, "roi_template string, roi_name string, rx0 int, ry0 int, rx1 int, ry1 int")
    models = t.values(MODELS, "model_key string, mean double, p99 double, recheck_score double, ng_score double")
    channels = t.values(INPUTS, "model_key string, pos int, channel string")
    matrices = t.values(MATRICES, "calibration_id string, light_id string, matrix array<double>")
    overrides = t.values([("k0", "CAM_A", "edge", "m_b")], "recipe_id string, camera_id string, roi_name string, roi_model_key string")
    frames = q_quality.frame_images(t, t.inspect_frames)
    return jobs.inspect(frames, recipes, views, lights, rois, models, channels, t.inspect_bank, matrices, overrides, 4, ["robot_x"], ["robot_rx"])


@query("job_train_bank")
def _(t):
    samples = t.embeddings.withColumns({"decision": F.when(F.col("label") == 9, "NG").otherwise("OK"), "quality_pass": F.col("label") != 8, "split": F.lit("train")})
    bank, _pca, thresholds = jobs.train_bank(samples, 8, 0.5, 64, 100)
    return thresholds.select(*[R(c) for c in STATS], F.lit(bank.count()).alias("bank_vectors"))


@query("job_collect_traces", """
WITH i AS (SELECT 'trace/' || sequence_id AS d, sequence_id, camera_id, light_id FROM v_frames)
SELECT r.decision, count(*) AS samples, count_if(EXISTS (SELECT 1 FROM v_truth x WHERE x.sequence_id = i.sequence_id AND x.camera_id = i.camera_id)) AS with_defect FROM i JOIN v_results r USING (sequence_id) WHERE r.error_code <> 9 AND r.sequence_id % 19 <> 4 AND light_id <> 'BAR_LEFT' GROUP BY 1""")
def _(t):
    images = t.frames.select(F.concat(F.lit("trace/"), F.col("sequence_id").cast("string")).alias("trace_dir"), F.concat("camera_id", F.lit("_"), "light_id", F.lit(".png")).alias("path"))
    defects = t.truth.select(F.concat(F.lit("trace/"), F.col("sequence_id").cast("string")).alias("trace_dir"), "camera_id", F.col("camera_id").alias("pose_id"), "roi_name", *fu.BOX)
    samples, _summary = jobs.collect_traces(t.trace_files, images, defects)
    return samples.groupBy("decision").agg(F.count("*").alias("samples"), F.count_if("has_defect").alias("with_defect"))


@query("job_collect_captures", """
WITH c AS (SELECT station_id, CASE WHEN i = 2 AND station_id % 4 = 1 AND decision = 'NG' THEN 9 ELSE i END AS l FROM (SELECT *, unnest([1, 2]) AS i FROM v_results)), k AS (SELECT station_id, count_if(l = 1) AS a, count_if(l = 2) AS b FROM c GROUP BY 1), g AS (SELECT * FROM k WHERE a = b AND a > 0), s AS (SELECT coalesce(sum(a), 0) AS n, count(*) AS cams FROM g)
SELECT 'all' AS section, '' AS value, 2 * n AS samples, n AS groups FROM s UNION ALL SELECT 'camera_id', 'C' || station_id, 2 * a, a FROM g UNION ALL SELECT 'light_id', l, n, n FROM s, (SELECT unnest(['DIFFUSE', 'POLAR_DIFFUSE']) AS l) WHERE n > 0
UNION ALL SELECT 'roi_name', 'seat', 2 * n, n FROM s WHERE n > 0 UNION ALL SELECT 'split', 'unassigned', 2 * n, n FROM s WHERE n > 0 UNION ALL SELECT 'label_status', 'unlabeled', 2 * n, n FROM s WHERE n > 0 UNION ALL SELECT 'skipped', '', 0, count(*) FROM k WHERE NOT (a = b AND a > 0)""")
def _(t):
    files = t.select("""SELECT concat('C', cast(station_id AS varchar(20)), '_', cast(ts_us AS varchar(20)), '_L', cast(CASE WHEN i = 2 AND station_id % 4 = 1 AND decision = 'NG' THEN 9 ELSE i END AS varchar(4)), '_original.png') AS file_name
      FROM (SELECT *, @UNNEST(1, 2) AS i FROM {v_results}) r""")
    lights = t.recipe_lights.where("recipe_id = 'r0'").select("pos", "light_id")
    rois = t.results.select(F.concat(F.lit("C"), F.col("station_id").cast("string")).alias("camera_id")).distinct().withColumn("roi_name", F.lit("seat"))
    _samples, _skipped, summary = jobs.collect_captures(files, lights, rois, ["L1", "L2"])
    return summary


@query("job_evaluate", MATCH + """, im AS (SELECT DISTINCT sequence_id, camera_id FROM (SELECT sequence_id, camera_id FROM v_candidates UNION SELECT sequence_id, camera_id FROM v_truth)),
m AS (SELECT im.*, coalesce(true_positives, 0) AS tp, coalesce(false_positives, 0) AS fp, coalesce(false_negatives, 0) AS fn FROM im LEFT JOIN e USING (sequence_id, camera_id)) SELECT count(*) AS samples, sum(tp) AS true_positives, sum(fp) AS false_positives, sum(fn) AS false_negatives FROM m""")
def _(t):
    images = t.candidates.select(*CUBE).union(t.truth.select(*CUBE)).distinct().withColumns({"roi_name": F.lit("seat"), "split": F.lit("")})
    _per_image, totals = jobs.evaluate(t.candidates, t.truth, images, CUBE, ["ordinal"], 0.5, 0.2)
    return totals.where("level = 'overall'").select("samples", "true_positives", "false_positives", "false_negatives")


@query("job_score_captures", f"""
WITH n AS (SELECT q.vec_id, min({DIST.format('q', 'b')}) AS distance FROM v_queries q CROSS JOIN v_bank b GROUP BY 1),
x AS (SELECT m.camera_id, round(least(greatest(tanh((distance - 0.9) / (2 * (1.15 - 0.9))), 0.0), 1.0), 6) AS score FROM v_manifest m JOIN n ON n.vec_id = m.frame_id)
SELECT 1 AS sequence_id, camera_id, CASE WHEN max(score) >= 0.8 THEN 'NG' WHEN max(score) >= 0.3 THEN 'RECHECK' ELSE 'OK' END AS decision, max(score) AS max_score, 'seat' AS roi_name, count(*) AS regions FROM x GROUP BY 2""")
def _(t):
    samples = t.manifest.withColumn("sequence_id", F.lit(1))
    vectors = t.embeddings.select(F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("image_path"), "vec_id", "embedding")
    out = jobs.score_captures(samples, vectors, t.bank, {"mean": 0.9, "p99": 1.15, "recheck": 0.3, "ng": 0.8}, 1)
    return out.withColumn("max_score", F.round("max_score", 6))


@query("job_line_report", """
SELECT station_id, count(*) AS total, count_if(decision = 'NG') AS ng, count_if(error_code IN (8, 10, 11, 12)) AS device_faults FROM v_results GROUP BY 1""")
def _(t):
    doubled = t.results.unionByName(t.results.where("decision = 'NG'"))
    parts = jobs.line_report(doubled, t.defects, t.actions, ["station_id"])
    joined = parts["counts"].join(parts["counters"], "station_id").join(parts["alarms"], "station_id").join(parts["reviews"], "station_id", "left")
    return joined.select("station_id", "total", "ng", F.col("device_fault_count").alias("device_faults"))
