"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one in each direction, read the bytes of a text; from their states every position gets a
probability for each language, and the mean over all positions of the document is its result.  The network is trained
in numpy by backpropagation through time on every byte of all labelled rows: tasks train it on shards of the rows, and
after each round their weights are averaged.  Its gates use x / (1 + |x|) in place of the exponential, which costs a
fifth.  Texts are read in segments (every byte is in one), so that thousands of segments advance together and a long
document needs no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from inspectlake.llm.common import as_bytes, column, free_name, map_arrow, shuffles_removed

HIDDEN = 8
SEGMENT = 128
#: Bytes of a segment in training, and segments of a step: at most, and at least where there are so many.
TRAIN_SEGMENT = 64
BATCH, LEAST_BATCH = 2048, 128
#: Steps of a training, at least; where all rows together give fewer, they are passed over again.
LEAST_STEPS = 200
#: Segments that are mixed before they are dealt into steps, and bytes of a shard, which one task trains on.
POOL = 65_536
SHARD_BYTES = 32 << 20
#: Shares of the rows, in sixteenths, that the rounds train on; after each the shards' weights are averaged.
ROUNDS = (1, 3, 4, 8)
RATE = 0.02
UNDETERMINED = "und"


class Layer:
    """One direction.  ``inputs`` has the input part of update gate, reset gate and candidate for each byte.

    In training segments are the last axis inside, so that every operation runs over long contiguous rows.
    """

    def __init__(self, rng: np.random.Generator):
        self.inputs = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        self.gates = rng.normal(0, 0.3, (HIDDEN, 2 * HIDDEN)).astype(np.float32)
        self.candidate = rng.normal(0, 0.3, (HIDDEN, HIDDEN)).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.gates, self.candidate]

    def states(self, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States (steps, rows, HIDDEN) for codes (steps, rows); ``trace`` gets what ``backward`` needs.

        A trace of the same shape is written over: fresh memory would cost as much as the work in it.
        """
        if trace is None:
            return self._plain(codes)
        steps, rows = codes.shape
        kind = self.inputs.dtype
        room = lambda width, *more: np.empty((*more, width * HIDDEN, rows), kind)
        gates, candidate = np.ascontiguousarray(self.gates.T), np.ascontiguousarray(self.candidate.T)
        out, h, given = room(1, steps), np.zeros((HIDDEN, rows), kind), np.empty((rows, 3 * HIDDEN), kind)
        if trace and trace[0].shape == (steps, 2 * HIDDEN, rows):
            out = trace[5]
        else:
            trace[:] = [*(room(width, steps) for width in (2, 2, 1, 1, 1)), out, room(3, steps)]
        for t in range(steps):
            gate, gate_slope, gated, new, new_slope = (x[t] for x in trace[:5])
            np.take(self.inputs, codes[t], axis=0, out=given, mode="clip")
            np.matmul(gates, h, out=gate)
            gate += given.T[: 2 * HIDDEN]
            # 0.5 / (1 + |x|) and 1 / (1 + |x|) are kept: their squares are the slopes.
            np.abs(gate, out=gate_slope)
            gate_slope += 1
            np.divide(0.5, gate_slope, out=gate_slope)
            gate *= gate_slope
            gate += 0.5
            np.multiply(gate[HIDDEN:], h, out=gated)
            np.matmul(candidate, gated, out=new)
            new += given.T[2 * HIDDEN :]
            np.abs(new, out=new_slope)
            new_slope += 1
            np.divide(1, new_slope, out=new_slope)
            new *= new_slope
            move = np.subtract(new, h, out=out[t])
            move *= gate[:HIDDEN]
            move += h
            h = move
        return out.transpose(0, 2, 1)

    def _plain(self, codes: np.ndarray) -> np.ndarray:
        """The same states without a trace.  With units last no array has to be turned over, which only ``backward`` would pay for."""
        steps, rows = codes.shape
        inputs = np.ascontiguousarray(self.inputs.reshape(256, 3, HIDDEN).transpose(1, 0, 2)).reshape(-1, HIDDEN)
        gates = np.ascontiguousarray(self.gates.reshape(HIDDEN, 2, HIDDEN).transpose(1, 0, 2))
        room = lambda *more: np.empty((*more, rows, HIDDEN), inputs.dtype)
        out, h, given, gate, bottom, new = room(steps), np.zeros((rows, HIDDEN), inputs.dtype), room(3), room(2), room(2), room()
        part = np.arange(3)[:, None] * 256
        for t in range(steps):
            np.take(inputs, part + codes[t], axis=0, out=given, mode="clip")
            np.matmul(h, gates, out=gate)
            gate += given[:2]
            np.abs(gate, out=bottom)
            bottom += 1
            np.divide(0.5, bottom, out=bottom)
            gate *= bottom
            gate += 0.5
            gate[1] *= h
            np.matmul(gate[1], self.candidate, out=new)
            new += given[2]
            np.abs(new, out=bottom[0])
            bottom[0] += 1
            new /= bottom[0]
            move = np.subtract(new, h, out=out[t])
            move *= gate[0]
            move += h
            h = move
        return out

    def backward(self, codes: np.ndarray, trace: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of ``weights`` from those of the states, backwards through time."""
        steps, rows = codes.shape
        gates, gate_slopes, gateds, news, new_slopes, states, d_given = trace
        d_out = d_out.transpose(0, 2, 1)
        start = np.zeros((HIDDEN, rows), states.dtype)
        carry, d, pulled = np.zeros_like(start), np.empty_like(start), np.empty_like(start)
        for t in range(steps - 1, -1, -1):
            h, update, reset = states[t - 1] if t else start, gates[t, :HIDDEN], gates[t, HIDDEN:]
            d_gate, d_new = d_given[t, : 2 * HIDDEN], d_given[t, 2 * HIDDEN :]
            np.add(d_out[t], carry, out=d)
            np.multiply(d, update, out=d_new)
            np.subtract(d, d_new, out=carry)
            d_new *= new_slopes[t]
            d_new *= new_slopes[t]
            np.matmul(self.candidate, d_new, out=pulled)
            np.subtract(news[t], h, out=d_gate[:HIDDEN])
            d_gate[:HIDDEN] *= d
            np.multiply(pulled, h, out=d_gate[HIDDEN:])
            d_gate *= gate_slopes[t]
            d_gate *= gate_slopes[t]
            d_gate *= 2
            pulled *= reset
            carry += pulled
            carry += np.matmul(self.gates, d_gate, out=pulled)
        d_gates = np.matmul(states[:-1], d_given[1:, : 2 * HIDDEN].transpose(0, 2, 1)).sum(axis=0)
        d_candidate = np.matmul(gateds, d_given[:, 2 * HIDDEN :].transpose(0, 2, 1)).sum(axis=0)
        where = codes.astype(np.intp).ravel()
        d_inputs = np.stack([np.bincount(where, d_given[:, k].ravel(), 256) for k in range(3 * HIDDEN)], axis=1).astype(states.dtype)
        return [d_inputs, d_gates, d_candidate]


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.back = Layer(rng), Layer(rng)
        self.read = rng.normal(0, 0.3, (2 * HIDDEN, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)
        #: Running means of gradients and of their squares, and the steps so far.
        self.first, self.second = ([np.zeros_like(w) for w in self.weights()] for _ in range(2))
        self.steps = 0.0
        #: Bytes of text that it was trained on, passes over the same rows counted once.
        self.bytes = 0
        #: What a step leaves in each direction; its arrays serve the next step too.
        self._traces: tuple[list, list] = ([], [])

    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights(), *self.back.weights(), self.read, self.bias]

    def state(self) -> np.ndarray:
        """All that training changes, as one vector."""
        parts = [*self.weights(), *self.first, *self.second, np.array([self.steps])]
        return np.concatenate([x.ravel().astype(np.float64) for x in parts])

    def restore(self, state: np.ndarray) -> "Network":
        at = 0
        for x in [*self.weights(), *self.first, *self.second]:
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size
        self.steps = float(state[at])
        return self

    def _judged(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Probabilities (steps, languages, rows) from states (steps, rows, HIDDEN) of both directions."""
        p = np.matmul(np.ascontiguousarray(self.read[:HIDDEN].T), ahead.transpose(0, 2, 1))
        p += np.matmul(np.ascontiguousarray(self.read[HIDDEN:].T), back.transpose(0, 2, 1))
        p += self.bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities (steps, languages, rows)."""
        return self._judged(self.ahead.states(codes), self.back.states(codes[::-1])[::-1])

    def learn(self, codes: np.ndarray, real: np.ndarray, labels: np.ndarray, rate: float) -> None:
        """One step on codes, real (steps, rows): bytes and whether they belong to the text; labels (rows)."""
        trace_a, trace_b = self._traces
        ahead, back = self.ahead.states(codes, trace_a), self.back.states(codes[::-1], trace_b)[::-1]
        d = self._judged(ahead, back)
        d[:, labels, np.arange(len(labels))] -= 1
        d *= real[:, None, :] / np.float32(max(1, real.sum()))
        turned = d.transpose(0, 2, 1)
        grads = [
            *self.ahead.backward(codes, trace_a, np.matmul(self.read[:HIDDEN], d).transpose(0, 2, 1)),
            *self.back.backward(codes[::-1], trace_b, np.matmul(self.read[HIDDEN:], d).transpose(0, 2, 1)[::-1]),
            np.concatenate([np.matmul(x.transpose(0, 2, 1), turned).sum(axis=0) for x in (ahead, back)]),
            d.sum(axis=(0, 2)),
        ]
        self.steps += 1
        pace = rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for w, g, m, v in zip(self.weights(), grads, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def fit(self, codes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, batch: int, rates: list[float]) -> None:
        """Passes over segments (rows, TRAIN_SEGMENT) of ``sizes`` bytes each, in an order of their own, one a rate."""
        rng = np.random.default_rng(len(codes))
        for rate in rates:
            order = rng.permutation(len(codes))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                real = np.arange(codes.shape[1])[:, None] < sizes[rows]
                self.learn(np.ascontiguousarray(codes[rows].T), real, labels[rows], rate)

    def documents(self, texts: list[bytes], rows: int = 2048) -> np.ndarray:
        """Mean probabilities over all positions of each text, (texts, languages); zero for an empty text."""
        out = np.zeros((len(texts), len(self.langs)))
        segments = np.array([-(-len(t) // SEGMENT) for t in texts])
        owner = np.repeat(np.arange(len(texts)), segments)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
        for at in range(0, len(owner), rows):
            own, where = owner[at : at + rows], place[at : at + rows]
            codes = np.zeros((len(own), SEGMENT), np.uint8)
            length = np.zeros(len(own), np.int64)
            # Segments of one text lie side by side, so each text is copied once for a block.
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for a, b in zip(cuts, [*cuts[1:], len(own)]):
                piece = texts[own[a]][where[a] * SEGMENT : (where[b - 1] + 1) * SEGMENT]
                codes[a:b].reshape(-1)[: len(piece)] = np.frombuffer(piece, np.uint8)
                length[a:b] = SEGMENT
                length[b - 1] = len(piece) - (b - 1 - a) * SEGMENT
            p = self.positions(np.ascontiguousarray(codes.T))
            short = np.flatnonzero(length < SEGMENT)
            for k in short:
                p[length[k] :, :, k] = 0
            np.add.at(out, own, p.sum(axis=0).T)
        sizes = np.array([max(1, len(t)) for t in texts])
        return out / sizes[:, None]


def _segments(texts: list[bytes], labels: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of all bytes of the texts, at most POOL at once: codes (rows, TRAIN_SEGMENT), their bytes, labels."""
    for text, label in zip(texts, labels):
        for at in range(0, len(text), POOL * TRAIN_SEGMENT):
            part = np.frombuffer(text, np.uint8)[at : at + POOL * TRAIN_SEGMENT]
            rows = -(-len(part) // TRAIN_SEGMENT)
            codes = np.zeros((rows, TRAIN_SEGMENT), np.uint8)
            codes.reshape(-1)[: len(part)] = part
            sizes = np.full(rows, TRAIN_SEGMENT)
            sizes[-1] = len(part) - (rows - 1) * TRAIN_SEGMENT
            yield codes, sizes, np.full(rows, label)


def _shard(langs: list[str], seed: int, state: np.ndarray, batch: int, rates: list[float]):
    """Trains from ``state`` on the rows (lang, text) of a shard and gives the new state, times the shard's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, pool, rows, seen = Network(langs, seed).restore(state), [], 0, 0
        place = {lang: k for k, lang in enumerate(langs)}

        def empty() -> None:
            if pool:
                network.fit(*(np.concatenate(x) for x in zip(*pool)), batch, rates)
                pool.clear()

        for given in batches:
            for piece in _segments(as_bytes(given["text"]), [place[lang] for lang in given["lang"].to_pylist()]):
                if rows + len(piece[0]) > POOL:
                    empty()
                    rows = 0
                pool.append(piece)
                rows += len(piece[0])
                seen += int(piece[1].sum())
        empty()
        if seen:
            new = network.state()
            yield pa.RecordBatch.from_pydict({"place": np.arange(len(new)), "total": new * seen, "bytes": np.full(len(new), seen)})

    return run


def train(docs: DataFrame, seed: int = 7) -> Network | None:
    """A network from all rows (doc_id, text, lang) that are not held out; None if no labelled row has a letter.

    Rows are dealt over shards and rounds by a hash.  In a round each shard's task goes on from the same weights, over
    every byte of its rows; the driver gets their mean, weighted by bytes.  One shard holds SHARD_BYTES, so the number
    of shards follows the input, not the cluster.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"), 4, 2))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.ceil(F.octet_length("text") / TRAIN_SEGMENT)).alias("segments")).collect()
    if not sizes:
        return None
    network = Network(sorted(r["lang"] for r in sizes), seed)
    segments, shards = sum(r["segments"] for r in sizes), -(-sum(r["bytes"] for r in sizes) // SHARD_BYTES)
    batch = int(np.clip(segments // shards // LEAST_STEPS, LEAST_BATCH, BATCH))
    passes = -(-LEAST_STEPS // -(-segments // batch)) if shards == 1 else 1
    rounds = ROUNDS if shards > 1 else (sum(ROUNDS),)
    draw = F.xxhash64("doc_id", "text", F.lit(seed))
    part = F.pmod(draw, F.lit(sum(ROUNDS)))
    begin = 0
    for share in rounds:
        # The pace falls to a tenth, from round to round or, where one round is all, from pass to pass.
        rates = [RATE * (1 - 0.9 * (begin / sum(ROUNDS) + k / passes)) for k in range(passes)]
        rows = known.where((part >= begin) & (part < begin + share)).select(draw.alias("draw"), "lang", "text")
        rows = rows.repartition(shards, "draw").sortWithinPartitions("draw", "lang").select("lang", "text")
        new = rows.mapInArrow(_shard(network.langs, seed, network.state(), batch, rates), "place long, total double, bytes long")
        with shuffles_removed(docs.sparkSession):
            mean = new.groupBy("place").agg((F.sum("total") / F.sum("bytes")).alias("value"), F.sum("bytes").alias("bytes")).orderBy("place").collect()
        if mean:
            network.bytes += mean[0]["bytes"]
            network.restore(np.array([r["value"] for r in mean]))
        begin += share
    return network


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """Adds lang_pred and score to ``docs`` (which needs text); other columns stay.

    Null texts and texts without a letter, and all texts if nothing could be learned, are ``und`` with score 0.
    """
    key = free_name(docs, "_letters")
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if network is None:
        return docs.select(*[column(docs, c) for c in names], F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(*[column(docs, c) for c in names], F.coalesce(column(docs, "text").rlike(r"\p{L}"), F.lit(False)).alias(key))

    def work(batch: pa.RecordBatch) -> dict:
        letters = batch[key].to_pylist()
        p = network.documents([t if ok else b"" for t, ok in zip(as_bytes(batch["text"]), letters)])
        best = p.argmax(axis=1)
        out = {c: batch[c] for c in names}
        out["lang_pred"] = [network.langs[k] if ok else UNDETERMINED for k, ok in zip(best, letters)]
        out["score"] = np.clip(np.where(letters, p.max(axis=1), 0.0), 0, 1)
        return out

    schema = StructType([docs.schema[c] for c in names]).add("lang_pred", StringType()).add("score", DoubleType())
    return map_arrow(rows, schema, work)


def identify(docs: DataFrame) -> DataFrame:
    """Trains on labelled rows that are not held out and labels every row: doc_id, held_out, lang_pred, score."""
    own = docs.select(*[column(docs, c).alias(c) for c in ("doc_id", "text", "lang")])
    out = predict(own.select("doc_id", "text"), train(own))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows of ``docs`` whose language could be told with a score of ``least`` or more; all columns unchanged."""
    own = docs.select(*[column(docs, c).alias(c) for c in ("doc_id", "text", "lang")])
    # Plain names while the two result columns are there, so that columns called alike cannot clash.
    plain = docs.toDF(*[c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)])
    kept = predict(plain, train(own)).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.drop("lang_pred", "score").toDF(*docs.columns)
