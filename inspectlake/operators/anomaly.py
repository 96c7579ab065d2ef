"""Nearest neighbours, anomaly scores, bank selection, calibration and PCA.

Vectors are packed into blocks inside Spark tasks and the blocks are joined by key, so every
distance is part of a matrix product and neither side passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from inspectlake.operators.ordered import Ordered, cut_lineage, largest_group

BLOCK_ROWS = 4096
#: Vectors of a bank slot, and of a query bucket: one cell of the grid holds one of each.
SLOT_BYTES = 32 << 20
#: Vectors of each, at most: a cell is a task, and its work grows with the product.
SLOT_ROWS = 16_384


def check_vectors(vectors: DataFrame, id_col: str, vec: str = "embedding") -> DataFrame:
    """Rows that cannot be used, with the reason: empty, off-dimension or not finite."""
    dim = vectors.select(F.max(F.size(vec)).alias("d")).scalar()
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    issue = (
        F.when(F.col(vec).isNull() | (F.size(vec) == 0), F.lit("empty"))
        .when(F.size(vec) != dim, F.lit("dimension"))
        .when(bad, F.lit("not finite"))
    )
    return vectors.select(id_col, issue.alias("issue")).where(F.col("issue").isNotNull())


def patch_rows(samples: DataFrame, patches: str, width: int, keys: list[str]) -> DataFrame:
    """One row per patch of a spatial embedding: row = i div width, col = i mod width."""
    return samples.select(*keys, F.posexplode(patches).alias("i", "embedding")).select(
        *keys, F.expr(f"cast(i div {width} AS int)").alias("patch_row"), (F.col("i") % width).alias("patch_col"), "embedding"
    )


# --- nearest neighbours -------------------------------------------------------------------------


def _packer(groups: list[str], id_col: str, vec: str, rows: int):
    """Turn runs of rows of one group into (group, ids, matrix bytes) blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            matrix = np.stack(batch[vec].to_numpy()).astype(np.float32)
            ids = batch[id_col].to_numpy()
            keys = [batch[g].to_numpy() for g in groups]
            change = np.zeros(len(ids), dtype=bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), len(ids)]
            out = []
            for a, b in zip(starts, starts[1:]):
                for s in range(a, b, rows):
                    e = min(s + rows, b)
                    out.append((*[k[a] for k in keys], ids[s:e].tolist(), matrix[s:e].tobytes()))
            yield pd.DataFrame(out, columns=[*groups, "ids", "block"])

    return run


def pack_vectors(df: DataFrame, id_col: str, vec: str, groups: list[str] = (), rows: int = BLOCK_ROWS) -> DataFrame:
    groups = list(groups)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*groups).schema) if groups else ""
    slim = df.select(*groups, F.col(id_col).cast("long").alias(id_col), vec)
    return slim.mapInPandas(_packer(groups, id_col, vec, rows), f"{fields}ids array<long>, block binary")


def _candidates(q: np.ndarray, b: np.ndarray, k: int, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of b) of all pairs that can be among the ``k`` nearest of their q; ``reached`` is a squared distance they need not exceed.

    Products are taken in single precision and everything within their error is kept, to be measured again.
    """
    q_norm, b_norm = (np.einsum("ij,ij->i", x, x, dtype=np.float64) for x in (q, b))
    most = b_norm.max()
    kind = np.float32 if 1e-20 < most < 1e30 and q_norm.max() < 1e30 else np.float64
    # Squared distances without the query's own norm, which is the same along a row.
    d2 = q.astype(kind, copy=False) @ b.astype(kind, copy=False).T
    d2 *= -2
    d2 += b_norm.astype(kind)
    take, parts = min(k, len(b)), 64
    if take <= parts // 4 and len(b) >= 8 * parts:
        # The smallest values of separate stretches are of separate points: the k-th of them bounds the k-th of all.
        width = len(b) // parts
        d2_least = d2[:, : parts * width].reshape(len(q), parts, width).min(axis=2)
    else:
        d2_least = d2
    kth = np.partition(d2_least, take - 1, axis=1)[:, take - 1].astype(np.float64)
    error = 4 * (q.shape[1] + 8) * np.finfo(kind).eps * (q_norm + most)
    return np.nonzero(d2 <= (np.minimum(kth, reached - q_norm) + error).astype(kind)[:, None])


def _visits(q: np.ndarray, centers: np.ndarray, probes: int) -> np.ndarray:
    """Whether a query (row) visits a cell (column): the ``probes`` cells with the nearest centres."""
    if probes >= len(centers):
        return np.ones((len(q), len(centers)), bool)
    d2 = (centers * centers).sum(1) - 2.0 * (q.astype(np.float64) @ centers.T)
    out = np.zeros(d2.shape, bool)
    np.put_along_axis(out, np.argpartition(d2, probes - 1, axis=1)[:, :probes], True, axis=1)
    return out


def _nearest(dim: int, k: int, centers: np.ndarray | None = None, probes: int = 0):
    """The ``k`` nearest of each query among the bank blocks that follow one another for its block.

    With ``centers`` a block is of one cell, and only the queries that visit it are compared with it.
    """

    def best(q_rows, ids, dist):
        order = np.lexsort((ids, dist, q_rows))
        q_rows, ids, dist = q_rows[order], ids[order], dist[order]
        keep = np.arange(len(q_rows)) - np.searchsorted(q_rows, q_rows, side="left") < k
        return q_rows[keep], ids[keep], dist[keep]

    def rows(q_ids, found):
        return pd.DataFrame({"query_id": q_ids[found[0]], "bank_id": found[1], "distance": found[2]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark, q_ids, q, found, visits = None, None, None, None, None
        for batch in batches:
            cells = [None] * len(batch) if centers is None else batch["cell"]
            for own_ids, q_block, b_ids, b_block, cell in zip(batch["q_ids"], batch["q_block"], batch["ids"], batch["block"], cells):
                if mark is None or q_block != mark or not np.array_equal(own_ids, q_ids):
                    if mark is not None:
                        yield rows(q_ids, found)
                    mark, q_ids = q_block, np.asarray(own_ids)
                    q = np.frombuffer(q_block, dtype=np.float32).reshape(-1, dim)
                    found = (np.array([], np.int64), np.array([], np.int64), np.array([], np.float64))
                    visits = None if centers is None else _visits(q, centers, probes)
                here = np.arange(len(q)) if visits is None else np.flatnonzero(visits[:, cell])
                if not len(here):
                    continue
                b = np.frombuffer(b_block, dtype=np.float32).reshape(-1, dim)
                reached = np.full(len(q), np.inf)
                last = np.flatnonzero(np.bincount(found[0], minlength=len(q)) == k)
                reached[last] = found[2][np.searchsorted(found[0], last, side="right") - 1] ** 2
                near_q, near_b = _candidates(q[here], b, k, reached[here])
                near_q = here[near_q]
                dist = np.sqrt(((q[near_q].astype(np.float64) - b[near_b]) ** 2).sum(1))
                more = (near_q, np.asarray(b_ids)[near_b], dist)
                found = best(*(np.concatenate(x) for x in zip(found, more)))
        if mark is not None:
            yield rows(q_ids, found)

    return run


def _join_blocks(q_blocks: DataFrame, b_blocks: DataFrame, on: list[str], dim: int, k: int, centers: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    # A merge join gives the bank blocks of one query block one after another.
    pairs = q_blocks.withColumnsRenamed({"ids": "q_ids", "block": "q_block"}).join(b_blocks.hint("merge"), on)
    found = pairs.select("q_ids", "q_block", "ids", "block", *([] if centers is None else ["cell"])).mapInPandas(
        _nearest(dim, k, centers, probes), "query_id long, bank_id long, distance double"
    )
    best = Window.partitionBy("query_id").orderBy("distance", "bank_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _need(rows: int, dim: int) -> int:
    """Parts of a side of the grid, so that a cell holds SLOT_ROWS vectors and SLOT_BYTES of it."""
    return max(1, math.ceil(max(rows / SLOT_ROWS, rows * dim * 4 / SLOT_BYTES)))


def _grid(q_blocks: DataFrame, b_blocks: DataFrame, groups: list[str], slots: int, buckets: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Blocks of both sides, each once in every cell of its row or column of the grid, and the columns they meet on."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    b_blocks = b_blocks.withColumn("slot", own(slots)).withColumn("bucket", spread(buckets))
    q_blocks = q_blocks.withColumn("bucket", own(buckets)).withColumn("slot", spread(slots))
    b_blocks, q_blocks = (x.withColumn("place", F.col("slot") * buckets + F.col("bucket")) for x in (b_blocks, q_blocks))
    on = [*groups, "place"]
    if slots * buckets > 1:
        # One task a cell; a hash of the place would put several into one.
        deal = lambda x: x.repartition(2 * slots * buckets, *on) if groups else x.repartitionById(slots * buckets, "place")
        b_blocks, q_blocks = deal(b_blocks), deal(q_blocks)
    return q_blocks, b_blocks, on


def _by_group(df: DataFrame, groups: list[str], id_col: str) -> DataFrame:
    """Rows of a group next to each other, a large group over several partitions."""
    if not groups:
        return df
    return df.repartition(*groups, F.pmod(F.xxhash64(id_col), F.lit(16))).sortWithinPartitions(*groups)


def knn_exact(
    queries: DataFrame,
    bank: DataFrame,
    k: int,
    query_id: str = "vec_id",
    bank_id: str = "vec_id",
    vec: str = "embedding",
    slots: int | None = None,
    buckets: int | None = None,
    groups: list[str] = (),
) -> DataFrame:
    """The ``k`` nearest bank vectors of every query by L2: query_id, bank_id, distance, rank.

    Both sides are packed into blocks and meet in a grid: bank blocks are spread over ``slots`` and visit every query
    bucket, query blocks over ``buckets`` and visit every slot, so a cell holds about SLOT_ROWS vectors, and SLOT_BYTES, of
    each side, whatever the size of the bank or the number of queries.  Cells are dealt over as many tasks, since their
    bytes say nothing of their work.  Each cell returns at most ``k`` rows per query, and only those are
    merged.  With ``groups`` (on both sides) a query is compared with the bank vectors of its group only.
    """
    groups = list(groups)
    size = bank.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("dim")).first()
    if not size["n"]:
        raise ValueError("the bank is empty")
    dim = int(size["dim"])
    slots = slots or _need(size["n"], dim)
    buckets = buckets or _need(queries.count(), dim)
    b_blocks = pack_vectors(_by_group(bank, groups, bank_id), bank_id, vec, groups)
    q_blocks = pack_vectors(_by_group(queries, groups, query_id), query_id, vec, groups, rows=1024)
    return _join_blocks(*_grid(q_blocks, b_blocks, groups, slots, buckets), dim, k)


def coarse_cells(count: int) -> int:
    """Number of index cells: the root of the bank size."""
    return min(max(int(math.sqrt(count)), 1), count)


#: Queries on which the number of probes is measured.
PROBE_SAMPLE = 256


def _nearest_cells(queries: DataFrame, centers: DataFrame, probes: int, query_id: str, vec: str) -> DataFrame:
    """query_id, cell and place (from 1) of the ``probes`` nearest cells of each query."""
    found = knn_exact(
        queries.select(F.col(query_id).cast("long").alias("vec_id"), F.col(vec).alias("v")), centers.select(F.col("cell").alias("vec_id"), F.col("center").alias("v")), probes, vec="v"
    )
    return found.select("query_id", F.col("bank_id").cast("int").alias("cell"), F.col("rank").alias("place"))


def measured_probes(queries: DataFrame, placed: DataFrame, centers: DataFrame, cells: int, k: int, recall: float, query_id: str, bank_id: str, vec: str) -> int:
    """Fewest nearest cells that hold ``recall`` of the true neighbours of a sample of queries.

    The sample is the PROBE_SAMPLE queries with the smallest hashes, so it is the same whatever the partitions.
    """
    sample = cut_lineage(queries.select(query_id, vec).orderBy(F.xxhash64(query_id), query_id).limit(PROBE_SAMPLE))
    true = knn_exact(sample, placed.select(bank_id, vec), k, query_id, bank_id, vec).select("query_id", F.col("bank_id").alias("_b"))
    in_cell = true.join(placed.select(F.col(bank_id).cast("long").alias("_b"), "cell"), "_b")
    places = in_cell.join(_nearest_cells(sample, centers, cells, query_id, vec), ["query_id", "cell"]).groupBy("place").count().orderBy("place").collect()
    total, seen = sum(r["count"] for r in places), 0
    for r in places:
        seen += r["count"]
        if seen >= recall * total:
            return r["place"]
    return cells


def knn_ivf(
    queries: DataFrame,
    bank: DataFrame,
    k: int,
    probes: int | None = None,
    query_id: str = "vec_id",
    bank_id: str = "vec_id",
    vec: str = "embedding",
    seed: int = 42,
    max_iter: int = 10,
    recall: float = 0.97,
) -> DataFrame:
    """Approximate kNN: bank vectors in k-means cells, each query searches its nearest ``probes`` cells.

    Without ``probes`` their number is measured: as many as hold ``recall`` of the true neighbours of a sample of
    queries.  The blocks of a cell, one or many, and the queries meet in the grid of ``knn_exact``: where a query has to
    visit most cells it still travels once a slot, not once a visit, and a task holds a cell of the grid.  The cells'
    centres, the root of the bank's size, are all that a model holds; tasks tell from them which cells a query visits.
    """
    count = bank.count()
    if not count:
        raise ValueError("the bank is empty")
    cells = coarse_cells(count)
    if cells == 1:
        return knn_exact(queries, bank, k, query_id, bank_id, vec)
    dim = bank.select(F.max(F.size(vec)).alias("d")).first()["d"]
    points = bank.select(F.col(bank_id).alias(bank_id), vec, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cell").fit(points)
    centers = bank.sparkSession.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cell long, center array<double>"
    )
    placed = cut_lineage(model.transform(points).select(bank_id, "cell", vec))
    if probes is None:
        probes = measured_probes(queries, placed, centers, cells, k, recall, query_id, bank_id, vec)
    parts = F.ceil(F.col("count") / BLOCK_ROWS)
    sized = placed.join(F.broadcast(placed.groupBy("cell").count()), "cell")
    rows = sized.repartition("cell", F.pmod(F.xxhash64(bank_id), parts)).sortWithinPartitions("cell").drop("count")
    b_blocks = pack_vectors(rows, bank_id, vec, ["cell"])
    q_blocks = pack_vectors(queries, query_id, vec, rows=1024)
    grid = _grid(q_blocks, b_blocks, [], _need(count, int(dim)), _need(queries.count(), int(dim)))
    return _join_blocks(*grid, int(dim), k, np.array(model.clusterCenters()), probes)


# --- scores -------------------------------------------------------------------------------------


def anomaly_score(distance, mean, p99) -> Column:
    d = F.col(distance) if isinstance(distance, str) else distance
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    mean, p99 = as_col(mean), as_col(p99)
    x = (d - mean) / (F.greatest(p99 - mean, F.lit(1e-6)) * 2.0)
    return F.least(F.greatest(F.tanh(x), F.lit(0.0)), F.lit(1.0))


def nearest_distances(
    queries: DataFrame, bank: DataFrame, query_id: str = "vec_id", bank_id: str = "vec_id", vec: str = "embedding", groups: list[str] = ()
) -> DataFrame:
    return knn_exact(queries, bank, 1, query_id, bank_id, vec, groups=groups).select(F.col("query_id").alias(query_id), "distance")


def anomaly_maps(patches: DataFrame, bank: DataFrame, image: str, height: int, width: int, mean, p99) -> tuple[DataFrame, DataFrame]:
    """Score per patch of whole images, and the images whose patch count is not height x width.

    ``patches`` has a unique ``vec_id``, ``patch_row``, ``patch_col`` and ``embedding``.
    """
    counts = patches.groupBy(image).agg(F.count("*").alias("patches"))
    short = counts.where(F.col("patches") != height * width)
    whole = patches.join(short.select(image), image, "left_anti")
    scored = nearest_distances(whole, bank).withColumn("score", anomaly_score("distance", mean, p99))
    # Scoring is the expensive step and its result is read several times: keep it.
    return cut_lineage(whole.select(image, "vec_id", "patch_row", "patch_col").join(scored, "vec_id")), short


def anomaly_summary(maps: DataFrame, image: str) -> DataFrame:
    return maps.groupBy(image).agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.count("*").alias("patches")
    )


def gated_maps(maps: DataFrame, image: str, recheck_score) -> DataFrame:
    """Maps whose strongest patch reaches the recheck score; only image maxima are shuffled back."""
    peak = maps.groupBy(image).agg(F.max("score").alias("peak")).where(F.col("peak") >= recheck_score)
    return maps.join(peak, image)


def hot_patches(maps: DataFrame, recheck_score, min_ratio: float = 0.5, relative: float = 0.3) -> DataFrame:
    """Patches of gated maps at or above max(recheck x min_ratio, peak x relative)."""
    recheck = recheck_score if isinstance(recheck_score, Column) else F.lit(float(recheck_score))
    return maps.where(F.col("score") >= F.greatest(recheck * min_ratio, F.col("peak") * relative))


# --- connected components -----------------------------------------------------------------------

IMAGE_PATCHES = 1 << 18


def _label_image(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Smallest row-major position reachable through side neighbours, per patch of one image."""
    width = int(cols.max()) + 2
    key = rows.astype(np.int64) * width + cols
    order = np.argsort(key)
    sorted_key = key[order]
    label = sorted_key.copy()

    def neighbour(step):
        at = np.searchsorted(sorted_key, sorted_key + step)
        at = np.minimum(at, len(sorted_key) - 1)
        hit = sorted_key[at] == sorted_key + step
        return np.flatnonzero(hit), at[hit]

    edges = [neighbour(1), neighbour(width)]
    while True:
        before = label.copy()
        for a, b in edges:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[np.searchsorted(sorted_key, label)]
        if np.array_equal(before, label):
            break
    out = np.empty_like(label)
    out[order] = label
    return out


def _spread_labels(hot: DataFrame, image: str) -> DataFrame:
    """The same labels by rounds of joins, for maps too large for one task."""
    node = F.struct("patch_row", "patch_col")
    state = cut_lineage(hot.withColumn("label", node))
    while True:
        steps = F.explode(
            F.array(
                *[
                    F.struct((F.col("patch_row") + dr).alias("r"), (F.col("patch_col") + dc).alias("c"))
                    for dr, dc in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))
                ]
            )
        )
        offers = state.select(image, steps.alias("to"), "label").groupBy(image, "to").agg(F.min("label").alias("offer"))
        offers = offers.select(image, F.col("to.r").alias("patch_row"), F.col("to.c").alias("patch_col"), "offer")
        took = state.join(offers, [image, "patch_row", "patch_col"])
        # Jump: take the label your label's own patch has reached.
        roots = took.select(image, F.struct("patch_row", "patch_col").alias("offer"), F.col("offer").alias("jump"))
        after = cut_lineage(
            took.join(roots, [image, "offer"]).withColumn("_moved", F.col("jump") != F.col("label")).withColumn("label", F.col("jump")).drop("offer", "jump")
        )
        moved = after.where("_moved").limit(1).count()
        state = after.drop("_moved")
        if not moved:
            return state


def patch_components(hot: DataFrame, image: str, image_patches: int = IMAGE_PATCHES) -> DataFrame:
    """4-connected components: patch box (half-open ends), strongest score, patch count."""
    slim = hot.select(image, "patch_row", "patch_col", "score")
    if largest_group(slim, [image]) <= image_patches:

        def label(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.assign(label=_label_image(pdf["patch_row"].to_numpy(), pdf["patch_col"].to_numpy()))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
        labelled = slim.groupBy(image).applyInPandas(label, f"{fields}, label long")
    else:
        labelled = _spread_labels(slim, image)
    return labelled.groupBy(image, "label").agg(
        F.min("patch_col").alias("col0"),
        F.min("patch_row").alias("row0"),
        (F.max("patch_col") + 1).alias("col1"),
        (F.max("patch_row") + 1).alias("row1"),
        F.max("score").alias("score"),
        F.count("*").alias("patches"),
    ).drop("label")


def component_boxes(components: DataFrame, grid_w: int, grid_h: int, roi_w: int, roi_h: int) -> DataFrame:
    """Component corners scaled from the patch grid to the region."""
    sx, sy = roi_w / grid_w, roi_h / grid_h
    return components.withColumns(
        {"rx0": F.col("col0") * sx, "ry0": F.col("row0") * sy, "rx1": F.col("col1") * sx, "ry1": F.col("row1") * sy}
    )


def component_order(boxes: DataFrame) -> DataFrame:
    return boxes.orderBy(F.desc("score"))


# --- bank selection and calibration -------------------------------------------------------------


def keep_count(n: int, ratio: float) -> int:
    if not 0.0 < ratio <= 1.0:
        raise ValueError("coreset ratio must be in (0, 1]")
    return max(1, math.ceil(n * ratio))


#: Up to so many ids are ranked in one task; more are ranked slice by slice.
RANK_ROWS = 100_000


def _ranked_ids(bank: DataFrame, id_col: str, order: list[str], hot_rows: int | None) -> DataFrame:
    """Ids and their exact rank ``_n`` (from 1) in ``order``: vectors stay where they are."""
    ids = bank.select(*dict.fromkeys([id_col, *order]))
    return Ordered(ids, [], order, RANK_ROWS if hot_rows is None else hot_rows).row_number("_n").result().select(id_col, "_n")


def coreset_stride(bank: DataFrame, ratio: float, id_col: str = "vec_id", hot_rows: int | None = None) -> DataFrame:
    """Every (n/keep)-th vector in id order; ids tell vectors apart.  Only ids are ranked, vectors join by id."""
    n = bank.count()
    keep = keep_count(n, ratio)
    if keep >= n:
        return bank
    step = n / keep
    ranked = _ranked_ids(bank, id_col, [id_col], hot_rows)
    # Row r is taken when some i has floor(i * step) = r; that i can only be near r / step.
    r = F.col("_n") - 1
    guess = F.floor(r / step)
    taken = F.lit(False)
    for shift in (0, 1):
        i = guess + shift
        taken = taken | ((i < keep) & (F.least(F.floor(i * step), F.lit(n - 1)) == r))
    return bank.join(ranked.where(taken).select(id_col), id_col, "left_semi")


def _closest_to(picked: np.ndarray):
    @F.pandas_udf("double")
    def distance_sq(vectors: pd.Series) -> pd.Series:
        v = np.stack(vectors.to_numpy()).astype(np.float64)
        best = np.full(len(v), np.inf)
        for p in picked:
            best = np.minimum(best, ((v - p) ** 2).sum(1))
        return pd.Series(best)

    return distance_sq


def coreset_greedy(bank: DataFrame, ratio: float, id_col: str = "vec_id", vec: str = "embedding", frontier: int = 256) -> DataFrame:
    """Farthest-point selection from the lowest id; ties go to the lower id.

    Each round reads the ``frontier`` farthest vectors.  Distances only shrink, so picks among them are
    final as long as they stay farther than everything outside the frontier; then all distances are
    brought up to date at once.  The driver only ever holds one frontier.
    """
    n = bank.count()
    keep = keep_count(n, ratio)
    if keep >= n:
        return bank.withColumn("pick", F.lit(None).cast("int"))
    spark = bank.sparkSession
    state = bank.withColumns({"gap": F.lit(float("inf")), "pick": F.lit(None).cast("int")})
    start = bank.orderBy(id_col).select(id_col, vec).first()
    picked, fresh, total = [(int(start[id_col]), 0)], [np.asarray(start[vec], dtype=np.float64)], 1
    while True:
        # One frontier of picks at most: marked in the table, then forgotten here.
        marks = F.broadcast(spark.createDataFrame(picked, f"{id_col} long, _new int"))
        state = state.join(marks, id_col, "left").withColumn("pick", F.coalesce("pick", "_new")).drop("_new")
        if total >= keep:
            return state.where(F.col("pick").isNotNull()).drop("gap")
        state = cut_lineage(state.withColumn("gap", F.least("gap", _closest_to(np.stack(fresh))(vec))))
        farthest = state.where(F.col("pick").isNull()).orderBy(F.desc("gap"), F.asc(id_col)).limit(frontier)
        # Partitions merge their farthest among executors; a plain collect would send a frontier from each to the driver.
        rows = farthest.select(id_col, vec, "gap").coalesce(1).collect()
        ids = np.array([r[id_col] for r in rows])
        vectors = np.stack([np.asarray(r[vec], dtype=np.float64) for r in rows])
        gaps = np.array([r["gap"] for r in rows])
        floor_gap, floor_id, whole = gaps[-1], ids[-1], len(rows) < frontier
        picked, fresh, open_ = [], [], np.ones(len(ids), dtype=bool)
        while total < keep and open_.any():
            best = np.lexsort((ids, -np.where(open_, gaps, -1.0)))[0]
            inside = gaps[best] > floor_gap or (gaps[best] == floor_gap and ids[best] <= floor_id)
            if fresh and not (whole or inside):
                break
            open_[best] = False
            picked.append((int(ids[best]), total))
            fresh.append(vectors[best])
            total += 1
            gaps = np.minimum(gaps, ((vectors - vectors[best]) ** 2).sum(1))


def split_halves(bank: DataFrame, id_col: str = "vec_id", seed: int = 42, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Two equal random halves in a fixed order of hashes: (reduced bank, held-out with ``draw``, half size).

    Ids tell vectors apart.  Only ids and hashes are ranked, vectors join by id.
    """
    n = bank.count()
    if n < 4:
        raise ValueError("calibration needs at least 4 bank vectors")
    half = n // 2
    mixed = bank.withColumn("_mix", F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))))
    ranked = cut_lineage(_ranked_ids(mixed, id_col, ["_mix", id_col], hot_rows))
    reduced = bank.join(ranked.where(F.col("_n") <= half).select(id_col), id_col, "left_semi")
    draws = ranked.where((F.col("_n") > half) & (F.col("_n") <= 2 * half)).select(id_col, (F.col("_n") - half - 1).alias("draw"))
    held = bank.join(draws, id_col)
    return reduced, held, half


def calibrate_distances(bank: DataFrame, id_col: str = "vec_id", vec: str = "embedding", sample_count: int | None = None, seed: int = 42) -> DataFrame:
    """Nearest distance of every held-out vector to the reduced bank: id, draw, distance.

    ``sample_count`` asks for that many of them, in the order of their hashes.
    """
    reduced, held, half = split_halves(bank, id_col, seed)
    sampled = held if sample_count is None else held.where(F.col("draw") < min(sample_count, half))
    return sampled.select(id_col, "draw").join(nearest_distances(sampled, reduced, id_col, id_col, vec), id_col)


def calibrate_thresholds(
    distances: DataFrame,
    patches_per_image: int,
    images: int = 500,
    recheck_quantile: float = 0.99,
    ng_quantile: float = 0.999,
    seed: int = 42,
) -> DataFrame:
    """One row: distance mean, mean and spread of simulated image maxima, and the two score thresholds.

    Each simulated image draws ``patches_per_image`` held-out distances by hash; the draws are counted
    per distance first, so the join to the distances moves one row per draw and nothing more.
    """
    if not 0.0 < recheck_quantile <= ng_quantile < 1.0:
        raise ValueError("quantiles must satisfy 0 < recheck <= ng < 1")
    distances = cut_lineage(distances)
    stats = distances.agg(F.count("*").alias("n"), F.avg("distance").alias("mean")).first()
    n, mean = stats["n"], stats["mean"]
    rounds = min(images, n)
    spark = distances.sparkSession
    cell = F.col("id")
    image, draw = F.floor(cell / patches_per_image), cell % patches_per_image
    text = F.concat(F.lit(f"{seed}|"), image.cast("string"), F.lit("|"), draw.cast("string"))
    draws = spark.range(rounds * patches_per_image).select(
        image.alias("image"), (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n).alias("draw")
    )
    maxima = draws.join(distances.select("draw", "distance"), "draw").groupBy("image").agg(F.max("distance").alias("peak"))
    spread = maxima.agg(F.avg("peak").alias("p99"), F.stddev_pop("peak").alias("std"))
    scored = maxima.withColumn("score", anomaly_score("peak", mean, spread.select("p99").scalar()))
    q = lambda level: F.percentile("score", F.lit(level))
    return scored.agg(
        F.lit(mean).alias("distance_mean"),
        F.avg("peak").alias("distance_p99"),
        F.stddev_pop("peak").alias("distance_std"),
        q(recheck_quantile).alias("recheck_score"),
        F.greatest(q(recheck_quantile), q(ng_quantile)).alias("ng_score"),
    )


# --- PCA ----------------------------------------------------------------------------------------


def vector_mean(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Position, mean and row count."""
    as_vector = array_to_vector(F.col(vec).cast("array<double>"))
    summary = vectors.select(Summarizer.metrics("mean", "count").summary(as_vector).alias("s"))
    return summary.select(F.posexplode(vector_to_array("s.mean")).alias("pos", "mean"), F.col("s.count").alias("count"))


def scatter_matrix(vectors: DataFrame, vec: str = "embedding") -> tuple[DataFrame, np.ndarray, int]:
    """Mean-centred scatter as rows (i, values); also the mean and the row count.

    Every task sends one partial matrix; rows of the partials are added up per matrix row.
    """
    means = vector_mean(vectors, vec).orderBy("pos").collect()
    mean, count = np.array([r["mean"] for r in means]), means[0]["count"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if batch.empty:
                continue
            centred = np.stack(batch[vec].to_numpy()).astype(np.float64) - mean
            part = centred.T @ centred
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "values": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "values": [np.stack(pdf["values"].to_numpy()).sum(0)]})

    parts = vectors.select(vec).mapInPandas(partial, "i int, values array<double>")
    return parts.groupBy("i").applyInPandas(add, "i int, values array<double>"), mean, count


def fit_pca(vectors: DataFrame, n_components: int, version: str, vec: str = "embedding") -> DataFrame:
    """Components by falling variance: version, component, weights, explained_ratio, mean.

    Only the D x D eigen step runs on the driver.  The largest weight of each component is positive.
    """
    scatter, mean, count = scatter_matrix(vectors, vec)
    dim = len(mean)
    if n_components > dim or n_components > count:
        raise ValueError(f"n_components {n_components} exceeds dimension {dim} or rows {count}")
    matrix = np.zeros((dim, dim))
    for row in scatter.collect():
        matrix[row["i"]] = row["values"]
    values, vectors_ = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:n_components]
    total = float(np.maximum(values, 0.0).sum())
    rows = []
    for rank, at in enumerate(order):
        weights = vectors_[:, at]
        weights = weights * (1.0 if weights[np.abs(weights).argmax()] >= 0 else -1.0)
        ratio = float(max(values[at], 0.0) / total) if total > 0 else 0.0
        rows.append((version, rank, weights.tolist(), ratio, mean.tolist()))
    return vectors.sparkSession.createDataFrame(
        rows, "version string, component int, weights array<double>, explained_ratio double, mean array<double>"
    )


def pca_project(vectors: DataFrame, components: list[list[float]], mean: list[float], id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(x - mean) times the components; the model is K x D numbers, whatever the data size."""
    basis, centre = np.asarray(components, dtype=np.float64), np.asarray(mean, dtype=np.float64)
    if basis.ndim != 2 or basis.shape[1] != centre.size:
        raise ValueError("component and mean dimensions differ")

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch[vec].to_numpy()).astype(np.float64)
            if x.shape[1] != centre.size:
                raise ValueError(f"vector dimension {x.shape[1]} != {centre.size}")
            yield pd.DataFrame({id_col: batch[id_col].to_numpy(), vec: list((x - centre) @ basis.T)})

    return vectors.select(F.col(id_col).cast("long").alias(id_col), vec).mapInPandas(project, f"{id_col} long, {vec} array<double>")
