"""The trie against brute force with blocks and slabs of any size, hot conversations and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from inspectlake.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string, depth string, seq int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], KIND)


def brute(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, sha, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        built[c] = tuple(base[:h] + v[h:])
    nodes: dict = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    children: dict = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if built[c] == path)))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def talks(seed, count):
    """Conversations that share beginnings, ends and all of their turns."""
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        c = rng.choice([k, k, 100 * k, k - 150])
        for turn in range(rng.choice([1, 1, 2, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "user", "user", None]), rng.choice(["aa", "aa", "aa", "aa", "bé", "", None])))
    return rows


@pytest.mark.parametrize("slab,block_rows", [(64, 16384), (64, 7), (2, 16384), (2, 5), (3, 1), (1, 4)])
def test_trie_against_brute_force(spark, slab, block_rows):
    rows = talks(slab * 1000 + block_rows, 150)
    assert result(prefix_trie.trie(frame(spark, rows), slab, block_rows)) == brute(rows)


def test_hot_rows(spark):
    """A third of the conversations are one text, another third goes on from it, one has hundreds of turns."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 200) for t in range(2)] + [(c, t, "user", f"t{t}") for c in range(200, 400) for t in range(4)]
    rows += [(7777, t, "user", "same") for t in range(700)] + [(7877, t, "user", "same") for t in range(650)]
    expected = brute(rows)
    assert result(prefix_trie.trie(frame(spark, rows), 64, 50)) == expected
    assert result(prefix_trie.trie(frame(spark, rows))) == expected


def test_large_group_is_placed_like_a_small_one(spark, monkeypatch):
    from inspectlake.operators import ordered

    rows = talks(5, 60) + [(3, None, "x", None), (3, None, "x", None), (3, 2, "a", "b"), (3, 2, "a", "b")]
    whole = result(prefix_trie.turns(frame(spark, rows)))
    monkeypatch.setattr(ordered, "HOT_GROUP_ROWS", 3)
    assert result(prefix_trie.turns(frame(spark, rows))) == whole


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, repeated turns, a conversation whose turns all fall away, a very long text."""
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, None, None, None), (5, 1, "user", ""), (300, 0, "user", "x" * 2_000_000), (301, 0, "user", "x" * 2_000_000)]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows += [(gone, 0, "user", "a"), (gone, 1, "user", "b")]
    got = result(prefix_trie.trie(frame(spark, rows)))
    assert got == brute(rows) and any(r[1] == 0 and r[7] != prefix_trie.NO_ENDS for r in got)
    assert prefix_trie.trie(frame(spark, [])).count() == 0
    assert prefix_trie.trie(frame(spark, [(None, 1, "a", "b")])).count() == 0
