"""Toxicity by a linear-chain conditional random field over tokens.

The field has two states, clean and toxic.  A token's evidence is the sum of the weights of its word, its first four,
five and six letters and its last three; neighbours are tied by transition weights.  Forward-backward marginals say how
likely each token is toxic.  A document's score is its largest marginal, and tokens of a half or more are offending.

Labels mark documents, so token labels come first: features are picked greedily, each the one that explains most of the
toxic documents not yet explained and occurs in almost no clean one.  Tokens with a picked feature are the toxic ones of
the training sequences.  Training uses a bounded sample of labelled rows; scoring reads every token of every text.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inspectlake.llm.common import column, held, map_arrow
from inspectlake.llm.langid import held_out

#: Labelled rows of each class in the sample, and the most characters of a text in it.
TRAIN_PER_CLASS = 1500
TRAIN_CHARS = 20_000
#: Training windows: tokens in each, and clean windows of each document.
WINDOW = 24
CLEAN_WINDOWS = 12
#: Tokens of a piece of a chain; pieces are worked on side by side, and messages are carried from one to the next.
CHAIN = 4096
LEAST = 0.7
#: Words whose evidence a task remembers.
REMEMBER = 150_000
_TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    return (f"w{word}", f"4{word[:4]}", f"5{word[:5]}", f"6{word[:6]}", f"e{word[-3:]}")


def pick_seeds(documents: list[tuple[set[str], int]], purity: float = 20.0, least: int = 2) -> set[str]:
    """Features that explain toxic documents, picked greedily.  ``documents``: features and label of each."""
    clean = Counter(f for found, label in documents if not label for f in found)
    by: dict[str, set[int]] = defaultdict(set)
    for k, (found, label) in enumerate(documents):
        if label:
            for f in found:
                by[f].add(k)
    by = {f: rows for f, rows in by.items() if f[0] != "e" and len(rows) >= least and len(rows) >= purity * clean[f]}
    toxic, total = sum(label for _, label in documents), max(1, sum(not label for _, label in documents))
    # A feature must be rarer in clean documents than chance explains: no clean one, though so many would be expected.
    by = {f: rows for f, rows in by.items() if len(rows) * total / max(1, toxic) >= 2}
    # Documents name several things, so what is frequent and never clean counts even where another feature explains it.
    # ``many`` is so often that chance alone would put all of them into toxic documents once in a hundred thousand.
    many = max(4, int(np.ceil(np.log(1e-5) / np.log(max(0.01, toxic / (toxic + total))))))
    seeds = {f for f, rows in by.items() if len(rows) >= many and len(rows) >= 50 * clean[f]}
    explained = set().union(*(by[f] for f in seeds)) if seeds else set()
    by = {f: left for f, rows in by.items() if f not in seeds and len(left := rows - explained) >= least}
    while by:
        # Of equal coverage the longer prefix is the more careful choice.
        best = max(by, key=lambda f: (len(by[f]) - 2 * clean[f], f[0] != "w", len(f), f))
        rows = by.pop(best)
        if len(rows) < least:
            break
        seeds.add(best)
        by = {f: left for f, have in by.items() if len(left := have - rows) >= least}
    return seeds


def without_copies(documents: list[list[str]]) -> list[bool]:
    """Whether each document shares none of four smallest shingle hashes with one before it: copies prove nothing twice."""
    seen: set[tuple[int, int]] = set()
    out = []
    for words in documents:
        codes = np.array([zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4))], np.uint64)
        least = [(j, int(((codes * np.uint64(m) + np.uint64(j)) % np.uint64(4294967291)).min())) for j, m in enumerate((1, 48271, 69621, 40692))]
        out.append(seen.isdisjoint(least))
        seen.update(least)
    return out


class Field:
    """Weights by feature, and odds of the transitions (clean-clean is 1)."""

    def __init__(self, weights: dict[str, float], bias: float, into: float, out: float, stay: float, start: float):
        self.weights, self.bias = weights, bias
        self.into, self.out, self.stay, self.start = into, out, stay, start

    def evidence(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def messages(self, evidence: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Odds of tokens by themselves, from what comes before (itself included), and from what comes after.

        Chains lie one after another.  A chain is worked on in pieces of CHAIN tokens, all pieces of all chains at once:
        over a piece messages change by a quotient of linear functions, so the pieces' 2 x 2 products carry each message
        over the cuts, and the result is that of the whole chain.
        """
        e = np.exp(np.clip(evidence, -30, 30))
        moves = into, out, stay, start = np.exp([self.into, self.out, self.stay, self.start])
        count = -(-sizes // CHAIN)
        chain = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
        starts = (np.cumsum(sizes) - sizes)[chain] + nth * CHAIN
        lengths = np.minimum(CHAIN, sizes[chain] - nth * CHAIN)
        enter, leave = _carried(e, starts, lengths, nth, count[chain], moves)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, enter, leave = starts[order], lengths[order], enter[order], leave[order]
        steps = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
        forward, backward = np.empty_like(e), np.ones_like(e)
        backward[starts + lengths - 1] = leave
        for t in range(steps):
            at = starts[: active[t]] + t
            if t == 0:
                forward[at] = e[at] * enter
            else:
                before = forward[at - 1]
                forward[at] = e[at] * (into + stay * before) / (1 + out * before)
        for t in range(steps - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            after = e[at + 1] * backward[at + 1]
            backward[at] = (out + stay * after) / (1 + into * after)
        return e, forward, backward

    def marginals(self, evidence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of the toxic state for the tokens of chains that lie one after another."""
        _, forward, backward = self.messages(evidence, sizes)
        odds = forward * backward
        return odds / (1 + odds)


def _carried(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, nth: np.ndarray, count: np.ndarray, moves) -> tuple[np.ndarray, np.ndarray]:
    """Per piece the factor of its first token from the piece before, and its last token's message from the piece after."""
    into, out, stay, start = moves
    enter, leave = np.full(len(starts), start), np.ones(len(starts))
    long = np.flatnonzero(count > 1)
    if not len(long):
        return enter, leave
    first, size = starts[long], lengths[long]
    ahead, back = (np.broadcast_to(np.eye(2), (len(long), 2, 2)).copy() for _ in range(2))
    for t in range(int(size.max())):
        on = np.flatnonzero(size > t)
        x = e[first[on] + t]
        ones, none = np.ones_like(x), np.zeros_like(x)
        step = np.stack([np.stack([x * stay, x * into], -1), np.stack([out * ones, ones], -1)], -2)
        if t == 0:  # a chain begins whatever stood before it
            begins = nth[long[on]] == 0
            step[begins] = np.stack([np.stack([none, x * start], -1), np.stack([none, ones], -1)], -2)[begins]
        ahead[on] = step @ ahead[on]
        ahead[on] /= np.abs(ahead[on]).max(axis=(1, 2), keepdims=True)
        turn = np.stack([np.stack([x * stay, out * ones], -1), np.stack([x * into, ones], -1)], -2)
        back[on] = back[on] @ turn
        back[on] /= np.abs(back[on]).max(axis=(1, 2), keepdims=True)
    apply = lambda m, v: (m[:, 0, 0] * v + m[:, 0, 1]) / (m[:, 1, 0] * v + m[:, 1, 1])
    place = nth[long]
    value = np.zeros(len(long))
    for k in range(int(place.max()) + 1):
        on = np.flatnonzero(place == k)
        if k:
            enter[long[on]] = (into + stay * value[on - 1]) / (1 + out * value[on - 1])
        value[on] = apply(ahead[on], value[on - 1] if k else value[on])
    from_end = count[long] - 1 - place
    for k in range(1, int(from_end.max()) + 1):
        on = np.flatnonzero(from_end == k)
        leave[long[on]] = apply(back[on + 1], leave[long[on + 1]])
    return enter, leave


def gradient(field: Field, evidence: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the labels' log-likelihood: by each token's evidence, and by the moves into, out, stay and start."""
    e, forward, backward = field.messages(evidence, sizes)
    odds = forward * backward
    gap = y - odds / (1 + odds)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    inner = np.ones(len(y), bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    before, after = forward[later - 1], (e * backward)[later]
    into, out, stay = np.exp(field.into) * after, np.exp(field.out) * before, np.exp(field.stay) * before * after
    total = 1 + into + out + stay
    y0, y1 = y[later - 1], y[later]
    moves = np.array([((1 - y0) * y1 - (into / total)).sum(), (y0 * (1 - y1) - (out / total)).sum(), (y0 * y1 - (stay / total)).sum(), gap[first].sum()])
    return gap, moves


def fit(sequences: list[list[str]], labels: list[list[int]], rounds: int = 60, rate: float = 0.3) -> Field:
    """Maximum likelihood by gradient steps; token and pair expectations come from forward-backward over all sequences."""
    names: dict[str, int] = {}
    rows, cols = [], []
    flat = [w for s in sequences for w in s]
    for k, word in enumerate(flat):
        for f in features(word):
            rows.append(k)
            cols.append(names.setdefault(f, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    y = np.array([v for s in labels for v in s], float)
    sizes = np.array([len(s) for s in sequences])
    w, moves = np.zeros(len(names)), np.array([-3.0, -1.0, -1.0, -1.0, -3.0])  # bias, into, out, stay, start
    sum_w, sum_m = np.full(len(names), 1e-8), np.full(5, 1e-8)
    weight = 1.0 / max(1.0, y.sum())
    for _ in range(rounds):
        evidence = moves[0] + np.bincount(rows, w[cols], len(flat))
        gap, g_moves = gradient(Field({}, moves[0], *moves[1:]), evidence, sizes, y)
        gap, g_moves = gap * weight, g_moves * weight
        g_w = np.bincount(cols, gap[rows], len(names)) - 1e-5 * w
        g_m = np.append(gap.sum(), g_moves)
        sum_w += g_w**2
        sum_m += g_m**2
        w += rate * g_w / np.sqrt(sum_w)
        moves += rate * g_m / np.sqrt(sum_m)
    return Field({f: float(w[k]) for f, k in names.items() if abs(w[k]) > 1e-6}, float(moves[0]), *map(float, moves[1:]))


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """A field from labelled rows that are not held out (crc32 of doc_id, mod 3, is not 1); None without both classes.

    Of repeated labels of an id the largest counts; null labels are left out.
    """
    marks = labels.select(column(labels, "doc_id").alias("doc_id"), column(labels, "toxic").alias("toxic"))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id")
    own = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text")).where(F.length("text").between(1, TRAIN_CHARS))
    rows: list[tuple[str, int]] = []
    for label in (0, 1):
        picked = marks.where(F.col("toxic") == label).orderBy(draw).limit(2 * TRAIN_PER_CLASS).select("doc_id")
        texts = own.join(F.broadcast(picked), "doc_id").orderBy(draw, "text").limit(TRAIN_PER_CLASS).select("text").toPandas()
        rows += [(t, label) for t in texts["text"]]
    if len({label for _, label in rows}) < 2:
        return None
    tokens = [_TOKEN.findall(t.lower()) for t, _ in rows]
    fresh = without_copies(tokens)
    tokens, rows = [t for t, ok in zip(tokens, fresh) if ok], [r for r, ok in zip(rows, fresh) if ok]
    seeds = pick_seeds([({f for w in set(ws) for f in features(w)}, label) for ws, (_, label) in zip(tokens, rows)])
    sequences, marks_of = [], []
    rng = np.random.default_rng(3)
    for words, (_, label) in zip(tokens, rows):
        hit = {w for w in set(words) if label and not seeds.isdisjoint(features(w))}
        places = [k for k, w in enumerate(words) if w in hit]
        if label:
            spots = [max(0, k - int(rng.integers(0, WINDOW))) for k in places]
        else:
            spots = rng.integers(0, max(1, len(words) - WINDOW), CLEAN_WINDOWS).tolist()
        for a in spots:
            piece = words[a : a + WINDOW]
            if piece:
                sequences.append(piece)
                marks_of.append([int(w in hit) for w in piece])
    return fit(sequences, marks_of)


class Evidence(dict):
    """Evidence by word, remembered up to a bound."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        value = self.field.evidence(word)
        if len(self) < REMEMBER:
            self[word] = value
        return value


def score_texts(texts: list[str], field: Field) -> tuple[list[float], list[str]]:
    """Scores, and offending spans as start:end in code points, comma-joined."""
    get = held(("evidence", id(field)), lambda: Evidence(field)).__getitem__
    values, sizes = array("d"), []
    lowered = [t.lower() for t in texts]
    for text in lowered:
        before = len(values)
        values.extend(map(get, _TOKEN.findall(text)))
        sizes.append(len(values) - before)
    if not len(values):
        return [0.0] * len(texts), [""] * len(texts)
    p = field.marginals(np.frombuffer(values, float), np.array(sizes))
    ends = np.cumsum(sizes)
    scores, spans = [], []
    for text, low, a, b in zip(texts, lowered, ends - sizes, ends):
        own = p[a:b]
        scores.append(float(own.max()) if b > a else 0.0)
        bad = set(np.flatnonzero(own >= 0.5).tolist())
        if bad:
            # Lower case has the same number of code points except for a few letters; then offsets are those of it.
            spans.append(",".join(f"{m.start()}:{m.end()}" for k, m in enumerate(_TOKEN.finditer(low)) if k in bad))
        else:
            spans.append("")
    return scores, spans


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of each row.  Null and empty texts score 0, as do all texts where
    nothing could be learned; spans are those of tokens whose marginal is a half or more."""
    own = docs.select(column(docs, "doc_id").alias("doc_id"), held_out(column(docs, "doc_id"), 3, 1).alias("held_out"), column(docs, "text").alias("text"))
    if field is None:
        return own.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit("").alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work(batch: pa.RecordBatch) -> dict:
        scores, spans = score_texts([t or "" for t in batch["text"].to_pylist()], shared.value)
        return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": [int(s >= LEAST) for s in scores], "spans": spans}

    return map_arrow(own, "doc_id long, held_out boolean, score double, predicted int, spans string", work)
