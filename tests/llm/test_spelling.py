"""Spelling variants against brute force, block boundaries and odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from inspectlake.llm import spelling

DOCS = "doc_id long, text string, word string, n string"


def plain(docs):
    """word: (form, root, n, n_near, form_n) by the rule itself, every pair of words compared."""
    counts: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w in words:
        found = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form[w] = found[0] if found and words[found[0]] >= 10 * words[w] else None
        out[w] = len(found)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], out[w], words[form[w]] if form[w] else None)
    return out


def result(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def near_texts(seed, letters, kinds, size):
    rng = random.Random(seed)
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(kinds)]
    words = []
    for _ in range(size):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.insert(at, rng.choice(letters)), lambda: w.pop(at), lambda: w.__setitem__(at, rng.choice(letters))])()
        words += ["".join(w)] * rng.choice([1, 1, 2, 15, 200] if rng.random() < 0.1 else [1, 2])
    rng.shuffle(words)
    return [(i, " ".join(words[i::50])) for i in range(50)]


def test_variants_against_brute_force(spark):
    docs = [*near_texts(1, "abÀÿ", 40, 2500), (None, "Ärgerlich ärgerlich ÄRGERLICH abcdefgh×÷ABCDEFGH " * 3), (7, None), (8, ""), (8, "a b c 1234567"), (9, "abcdefg"), (9, "abcdefg")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    assert result(spelling.variants(df)) == plain(docs)


def test_blocks_of_large_cells(spark):
    """Cells cut into blocks, and tiles with cut edges, give what whole cells give."""
    docs = near_texts(2, "ab", 30, 4000)
    words = spelling.words(spark.createDataFrame(docs, "doc_id long, text string"))
    whole = sorted(map(tuple, spelling.near_words(words).collect()))
    assert sorted(map(tuple, spelling.near_words(words, block_rows=60).collect())) == whole
    expected = {w: v for w, v in plain(docs).items() if v[3]}
    assert {r[0]: r[1] for r in whole} == {w: v[3] for w, v in expected.items()}


def test_tile_boundaries(monkeypatch):
    """Every pair of a cell is seen once, whatever the size of the tiles."""
    import numpy as np

    rng = random.Random(3)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([7, 8]))) for _ in range(200)})
    rows = spelling._Rows(names)
    own = np.zeros(len(names), np.int64)

    def pairs():
        return {tuple(sorted(p)) for box in range(3) for p in zip(*(x.tolist() for x in spelling._by_tiles(rows, own, 0, 0, 7, box)))}

    large = pairs()
    monkeypatch.setattr(spelling, "TILE", 7)
    assert pairs() == large and large


def test_long_chain_of_forms(spark):
    """Each word ten times as frequent as the one before: the root is found through the whole chain."""
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {w: chain[-1] for w in chain[:-1]}


def test_odd_rows(spark):
    """No rows, only nulls, and one text of a million runs; no result column is read from the table."""
    empty = spark.createDataFrame([], DOCS)
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "a", "b"), (None, "", "a", "b")], DOCS)).count() == 0
    long = [(1, "variants " * 300_000 + "variantz variantz")]
    got = result(spelling.variants(spark.createDataFrame([(1, long[0][1], "a", "b")], DOCS)))
    assert got == plain(long)
