"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A vector becomes CODE_BITS signs of its rotated coordinates; rotations are learned on a bounded sample so that signs
lose little (alternating signs and orthogonal fits).  The angle between two vectors shows in the Hamming distance of
their codes, so for each query a radius follows from a score that it certainly reaches (its k-th best of the sample) and
a margin measured on pairs of the sample.  All codes within that radius are retrieved, and the products of the vectors
themselves decide.

Codes are cut into SUBSTRINGS words of 64 bits, and each is an index of its own: the distinct values of a shard with
the rows that have them.  A code within radius r of a query has at least one substring within r div SUBSTRINGS, so the
distinct values within that distance name every candidate.  Copies share values, so a vector that makes up a third of
the table is looked at once a shard.

Largest inner products become smallest angles by one more coordinate, sqrt(M^2 - |x|^2); M is the largest norm of the
vector's band (norms within a factor of two), so that one long vector does not flatten all others.

Scale: the table is indexed once and written.  Queries and rows meet in a grid of query blocks and shards, each cell a
task-sized group, whatever the copies; only products that can still be among a query's k leave a cell, at most k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from inspectlake.llm.common import column, written

CODE_BITS = 256
SUBSTRINGS = CODE_BITS // 64
#: Rows of the sample that fits the rotations and the margin, and gives every query its first score.
SAMPLE = 8192
SAMPLE_BYTES = 1 << 26
#: Sample rows that are compared with the sample to measure the margin, and the share of close pairs it has to hold.
PROBES = 512
HOLDS = 0.99
ROUNDS = 10
SHARD_ROWS = 4096
QUERY_ROWS = 4096
#: Queries that are compared with a shard's values at once; bounds memory.
STEP = 64
_ROW = "uid long, vec_id long, band int, vec binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and double vector of the rows that take part: not null, without null or non-finite parts, not all zero."""
    v = column(vectors, "embedding").cast("array<double>")
    rows = vectors.select(column(vectors, "vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0.0))


def _norm(v: np.ndarray) -> np.ndarray:
    """Norms without overflow or underflow of the squares."""
    big = np.abs(v).max(axis=-1)
    return big * np.sqrt(((v / big[..., None]) ** 2).sum(axis=-1))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """uid, vec_id, band and the vector's doubles as bytes; shorter vectors are padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _dense(batch["v"], size)
            band = np.round(np.log2(_norm(v))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["vec_id"], pa.array(band), pa.array([x.tobytes() for x in v], pa.binary())], names=["uid", "vec_id", "band", "vec"])

    return rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "v").mapInArrow(run, _ROW)


def _dense(col: pa.Array, size: int) -> np.ndarray:
    n = np.asarray(pc.list_value_length(col), np.int64)
    flat = np.asarray(col.flatten(), np.float64)
    if len(n) and (n == size).all():
        return flat.reshape(len(n), size)
    out = np.zeros((len(n), size))
    out[np.arange(size)[None, :] < n[:, None]] = flat
    return out


def _doubles(col) -> np.ndarray:
    """Rows of packed doubles (Arrow binary column) as a matrix."""
    raw = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    parts = raw.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)


class Codes:
    """Rotations, largest norms by band, and the margin of distances over what angles say."""

    def __init__(self, sample: np.ndarray, bands: dict[int, float]):
        self.bands = bands
        self.size = sample.shape[1]
        rng = np.random.default_rng(7)
        lifted = self.lift(sample)
        self.turns = [self._fit(lifted, rng) for _ in range(-(-CODE_BITS // (self.size + 1)))]
        self.margin = 0.0

    @staticmethod
    def _fit(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A rotation whose coordinates' signs lie close to the rotated vectors."""
        turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(ROUNDS if len(x) > x.shape[1] else 0):
            left, _, right = np.linalg.svd(x.T @ np.where(x @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        return turn

    def lift(self, v: np.ndarray) -> np.ndarray:
        """Unit vectors of one more coordinate, in which a band's largest product is the smallest angle."""
        norm = _norm(v)
        most = np.array([self.bands[b] for b in np.round(np.log2(norm)).astype(int).tolist()])
        scaled = v / most[:, None]
        return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (norm / most) ** 2))[:, None]])

    def _signs(self, lifted: np.ndarray) -> np.ndarray:
        bits = np.hstack([lifted @ t >= 0 for t in self.turns])[:, :CODE_BITS]
        return np.packbits(bits, axis=1).view(np.uint64)

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        return self._signs(self.lift(v))

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        return self._signs(np.hstack([v / _norm(v)[:, None], np.zeros((len(v), 1))]))

    def radius(self, queries: np.ndarray, score: np.ndarray, band: int) -> np.ndarray:
        """Distances up to which rows of ``band`` can reach ``score``; all of them where there is no score yet."""
        with np.errstate(over="ignore", invalid="ignore"):
            cosine = np.clip(score / (_norm(queries) * self.bands[band]), -1.0, 1.0)
        found = np.floor(CODE_BITS * np.arccos(cosine) / math.pi + self.margin)
        return np.where(np.isfinite(score), np.clip(found, 0, CODE_BITS), CODE_BITS).astype(np.int64)

    def measure(self, sample: np.ndarray, k: int) -> None:
        """Sets the margin: HOLDS of the k closest pairs of the sample have distances below angle plus margin."""
        codes, over = self.of_rows(sample), []
        band = np.round(np.log2(_norm(sample))).astype(int)
        most = np.array([self.bands[b] for b in band.tolist()])
        probes = sample[:PROBES]
        own = self.of_queries(probes)
        for i, (q, code) in enumerate(zip(probes, own)):
            cosine = sample @ q / (_norm(q[None])[0] * most)
            cosine[i] = -2.0
            near = np.argsort(-cosine)[: min(k, len(sample) - 1)]
            away = np.bitwise_count(codes[near] ^ code).sum(axis=1)
            over.append(away - CODE_BITS * np.arccos(np.clip(cosine[near], -1, 1)) / math.pi)
        over = np.concatenate(over) if over else np.zeros(0)
        self.margin = max(0.0, float(np.quantile(over, HOLDS))) if len(over) else float(CODE_BITS)


class Index:
    """Rows of one shard: for each substring its distinct values and the rows that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(SUBSTRINGS):
            order = np.argsort(codes[:, j], kind="stable")
            ordered = codes[order, j]
            start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            self.tables.append((ordered[start], np.append(start, len(order)), order))

    def within(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs whose codes are at most the query's radius apart: all of them, once each."""
        hits = np.zeros((len(queries), len(self.codes)), bool)
        for j, (values, starts, order) in enumerate(self.tables):
            q, at = np.nonzero(np.bitwise_count(values[None, :] ^ queries[:, j, None]) <= (radius // SUBSTRINGS)[:, None])
            sizes = starts[at + 1] - starts[at]
            many = np.repeat(starts[at] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum()) if len(at) else at
            hits[np.repeat(q, sizes), order[many]] = True
        q, row = np.nonzero(hits)
        near = np.bitwise_count(self.codes[row] ^ queries[q]).sum(axis=1) <= radius[q]
        return q[near], row[near]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.einsum("ij,ij->i", a, b)


def _first(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: larger scores, then smaller ids."""
    order = np.lexsort((ids, -score, q))
    start = np.append(True, q[order][1:] != q[order][:-1]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0)) if len(order) else order
    return order[rank < k]


def _ids(col: pa.Array) -> np.ndarray:
    """Ids with null as the largest, which ties rank last."""
    return np.asarray(pc.fill_null(col, np.iinfo(np.int64).max))


def search(vectors: DataFrame, every: int, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose vec_id ``every`` divides.

    Nearness is the inner product in double precision; ties go to the smaller vec_id (null last).  All rows but the
    query's own are candidates; with at most ``k`` of them all are given.  Vectors that are null, zero or hold null or
    non-finite parts take no part; shorter vectors are padded with zeros.  Rows that share a vec_id are told apart: each
    is a candidate for the other, and each is a query.  An empty table gives no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    size = rows.agg(F.max(F.size("v"))).first()[0]
    out = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], out)
    table = written(_packed(rows, size), "vectors")
    count = table.count()
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    share = min(1.0, 1.2 * wanted / count)
    picked = table.where(F.pmod(F.xxhash64("uid"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).orderBy(F.xxhash64("uid"), "uid").limit(wanted)
    sample = picked.select("uid", "vec_id", "vec").toArrow()
    base, base_uid = _doubles(sample["vec"]), sample["uid"].to_numpy()
    codes = Codes(base, _largest(table))
    codes.measure(base, k)
    held = spark.sparkContext.broadcast((codes, base, base_uid))

    shards = max(1, -(-count // SHARD_ROWS))
    asked = table.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their k best of the sample, and the score of the last of these, which the true k-th reaches."""
        codes, base, base_uid = held.value
        longest = max(codes.bands.values())
        for batch in batches:
            if not batch.num_rows:
                continue
            q, uid = _doubles(batch["vec"]), batch["uid"].to_numpy()
            least, near = np.full(len(q), -np.inf), np.full((len(q), k), -1)
            for at in range(0, len(q), STEP):
                with np.errstate(over="ignore", invalid="ignore"):
                    score = q[at : at + STEP] @ base.T
                score[uid[at : at + STEP, None] == base_uid[None, :]] = -np.inf
                score[np.isnan(score)] = -np.inf
                if score.shape[1] > k:
                    # Sums of a matrix product may end in other last bits than those of a single pair.
                    top = np.argpartition(score, -k, axis=1)[:, -k:]
                    kth = np.take_along_axis(score, top, 1).min(axis=1)
                    least[at : at + STEP] = kth - 1e-12 * _norm(q[at : at + STEP]) * longest
                    near[at : at + STEP] = base_uid[top]
            yield pa.RecordBatch.from_arrays(
                [batch["uid"], batch["vec_id"], batch["vec"], pa.array(least), pa.array([x.tobytes() for x in near], pa.binary())], names=["uid", "vec_id", "vec", "least", "near"]
            )

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of one shard for one block of queries."""
        codes, _, _ = held.value
        found: dict[str, list] = {name: [] for name in ("quid", "query_id", "uid", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            queries, vecs = _doubles(left["vec"]), _doubles(right["vec"])
            quid, least, uid = left["uid"].to_numpy(), left["least"].to_numpy(), right["uid"].to_numpy()
            ids = _ids(right["vec_id"].combine_chunks())
            query_codes, row_codes = codes.of_queries(queries), codes.of_rows(vecs)
            band = right["band"].to_numpy()
            known = np.frombuffer(b"".join(left["near"].to_pylist()), np.int64).reshape(len(queries), k)
            for b in np.unique(band):
                of = np.flatnonzero(band == b)
                of = of[np.argsort(uid[of])]
                index, radius = Index(row_codes[of]), codes.radius(queries, least, int(b))
                for at in range(0, len(queries), STEP):
                    i, j = index.within(query_codes[at : at + STEP], radius[at : at + STEP])
                    # The best of the sample are known by name, so that no query is left with fewer than k.
                    place = np.minimum(np.searchsorted(uid[of], known[at : at + STEP]), len(of) - 1)
                    x, y = np.nonzero(uid[of][place] == known[at : at + STEP])
                    pair = np.union1d(i * len(of) + j, x * len(of) + place[x, y])
                    i, j = pair // len(of) + at, of[pair % len(of)]
                    apart = quid[i] != uid[j]
                    i, j = i[apart], j[apart]
                    score = np.concatenate([_products(queries[i[s : s + 65536]], vecs[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
                    fits = score >= least[i]
                    i, j, score = i[fits], j[fits], score[fits]
                    top = _first(i, score, ids[j], k)
                    for name, values in zip(found, (quid[i[top]], left["vec_id"].to_numpy()[i[top]], uid[j[top]], right["vec_id"].take(pa.array(j[top])), score[top])):
                        found[name].append(values)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        arrays = [pa.chunked_array([c for v in values for c in (v.chunks if isinstance(v, pa.ChunkedArray) else [pa.array(v, kind)])], kind) for (_, values), kind in zip(found.items(), kinds)]
        return pa.Table.from_arrays(arrays, names=list(found))

    spread = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    queries = asked.select("uid", "vec_id", "vec").mapInArrow(first_scores, "uid long, vec_id long, vec binary, least double, near binary")
    queries = spread(queries.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")), "shard", shards)
    places = spread(table.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")), "block", blocks)
    best = queries.groupBy("block", "shard").cogroup(places.groupBy("block", "shard")).applyInArrow(cell, "quid long, query_id long, uid long, vec_id long, score double")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _largest(table: DataFrame) -> dict[int, float]:
    """The largest norm of each band; bands are powers of two, so there are some two thousand at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for batch in batches:
            if batch.num_rows:
                for b, n in zip(batch["band"].to_pylist(), _norm(_doubles(batch["vec"])).tolist()):
                    most[b] = max(most.get(b, 0.0), n)
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.float64())], names=["band", "most"])

    found = table.select("band", "vec").mapInArrow(run, "band int, most double").groupBy("band").agg(F.max("most").alias("most"))
    return {r["band"]: r["most"] for r in found.collect()}
