"""A prefix trie of conversations from padded matrices of turn ids.

A turn is known by a 128-bit hash of its place, role and text.  Conversations are rows of a padded matrix of turn ids;
sorted lexicographically, every node of the trie is a run of rows.  A column's change mask, OR-accumulated from the
left, marks the rows where nodes of that depth start, and reduceat over these starts gives every value of every depth.

The rows are sorted by range into shards, and shards into blocks.  All values are sums over rows or minima, provided
each row knows how much it shares with the row before (it adds no saving where it is the first of a node, and a child
where it starts one) and whether the row after goes on from its end (then the end is no leaf).  A block does not know
its neighbours: it counts as if there were none, hands on its first and last row, and flags the nodes on their paths.
Flagged parts are summed by node with the corrections that follow from what the last row of a block shares with the
first row of the next.

Long conversations are cut into slabs of SLAB turns, whose rows are sorted under the hash of all turns before the slab;
what leaves and savings lie in a conversation's later slabs is added to its row of each earlier one.  So neither a
block nor a row grows with the longest conversation.  Hot conversations, first turns and copies are spread, since rows
are ordered by conversation last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from inspectlake.llm.common import column, written
from inspectlake.operators.ordered import Ordered

#: Turns of a row; rows of a block.
SLAB = 64
BLOCK_ROWS = 16_384
#: Conversation c takes the first h turns of conversation c - c % GROUP, where h is a checksum modulo SHARED.
GROUP = 100
SHARED = 6
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NONE = np.iinfo(np.int64).max
#: Ids of a node's ends travel in pieces of so many.
ENDS_PIECE = 8192

_PART = (
    "kind string, block long, at int, slab int, depth int, ka long, kb long, pa long, pb long, conv long, parent_conv long, "
    "n_convs long, n_children long, n_leaves long, saved long, flagged boolean, ends string, "
    "path_a array<long>, path_b array<long>, sizes array<long>, leaf boolean, row_conv long"
)
_NAMES = [p.split()[0] for p in _PART.split(", ")]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), sha, n of each turn in order.

    Turns are ordered by turn (null first), equal ones by the hash of role and text; a null role or text is empty.  Rows
    without a conv_id belong to no conversation and take no part.
    """
    role, text = (F.coalesce(column(conversations, c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length of the role keeps role and text apart.
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = column(conversations, "turn").cast("long")
    rows = conversations.select(
        column(conversations, "conv_id").cast("long").alias("conv_id"), turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), sha.alias("sha"), F.length(text).cast("long").alias("n")
    ).where("conv_id is not null")
    placed = Ordered(rows, ["conv_id"], ["known", "turn", "sha", "n"]).row_number("pos").result()
    return placed.select("conv_id", (F.col("pos") - 1).cast("long").alias("pos"), "sha", "n")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, pos, sha, n of every rebuilt conversation; one without turns has a row of null pos.

    Conversation c begins with the first h turns of conversation c - c % GROUP (all if fewer, none if it is absent),
    h = crc32 of the decimal c modulo SHARED, and goes on with its own turns after its first h.
    """
    own = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    heads = own.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < SHARED - 1)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "sha", "n"))).alias("head"))
    every = own.groupBy("conv_id", "h", "base").agg(F.lit(1).alias("one")).drop("one").join(heads, "base", "left")
    first = every.select("conv_id", F.explode_outer(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("t")).select("conv_id", "t.pos", "t.sha", "t.n")
    counts = heads.select("base", F.size("head").alias("size"))
    rest = own.where("pos >= h").join(counts, "base", "left")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.least(F.col("h"), F.coalesce("size", F.lit(0)))).alias("pos"), "sha", "n")
    return first.unionByName(rest)


def _rows(placed: DataFrame, slab: int) -> DataFrame:
    """slab, ka, kb, seq, more, conv: a row for each conversation and slab.

    ``seq`` holds the two halves of each turn's id and its size; ka and kb are the hash of all turns before the slab
    (each turn's id depends on its place, so the bitwise sum of ids stands for their sequence).
    """
    half = lambda seed: F.xxhash64(F.lit(seed), F.col("pos"), F.col("sha"))
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", half(1).alias("a"), half(2).alias("b"), "n"))
    rows = placed.select(F.col("conv_id").alias("conv"), F.coalesce(F.expr(f"pos div {slab}"), F.lit(0)).cast("int").alias("slab"), turn.alias("t"))
    rows = rows.groupBy("conv", "slab").agg(F.sort_array(F.collect_list("t")).alias("t"))
    seq = F.transform("t", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["n"].alias("n")))
    rows = written(rows.select("slab", "conv", seq.alias("seq")), "rows")
    none = F.lit(0).cast("long")
    if not rows.where("slab > 0").limit(1).count():
        return rows.select("slab", none.alias("ka"), none.alias("kb"), "seq", F.lit(False).alias("more"), "conv")
    total = lambda part: F.aggregate("seq", none, lambda x, t: x.bitwiseXOR(t[part]))
    spots = rows.select("conv", "slab", total("a").alias("a"), total("b").alias("b"))
    before = Window.partitionBy("conv").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    keys = spots.select(
        "conv", "slab", F.coalesce(F.bit_xor("a").over(before), none).alias("ka"), F.coalesce(F.bit_xor("b").over(before), none).alias("kb"), F.lead("slab").over(Window.partitionBy("conv").orderBy("slab")).isNotNull().alias("more")
    )
    return written(rows.join(keys, ["conv", "slab"]).select("slab", "ka", "kb", "seq", "more", "conv"), "rows")


class _Block:
    """Sorted rows as matrices with the starts of all nodes."""

    def __init__(self, table: pa.Table):
        get = lambda name: table[name].to_numpy()
        seq = table["seq"].combine_chunks()
        size = np.diff(seq.offsets.to_numpy()).astype(np.int64)
        a, b, n = (seq.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        count, width = len(size), int(size.max(initial=0))
        inside = np.arange(width)[None, :] < size[:, None]
        # Ids as ranks of (a, b), padded with -1, so that a conversation comes before those that go on from its end.
        rank = np.zeros(len(a), np.int64)
        by = np.lexsort((b, a))
        rank[by] = np.cumsum(np.append(False, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])))[: len(a)] if len(a) else rank
        ids = np.full((count, width), -1, np.int64)
        ids[inside] = rank
        parts = {k: np.zeros((count, width), np.int64) for k in "abn"}
        for k, v in zip("abn", (a, b, n)):
            parts[k][inside] = v
        ka, kb, slab, conv, more = (get(k) for k in ("ka", "kb", "slab", "conv", "more"))
        order = np.lexsort((conv, more, *ids.T[::-1], kb, ka, slab))
        self.ids, self.size, self.sizes = ids[order], size[order], parts["n"][order]
        self.slab, self.conv, self.more = slab[order], conv[order], more[order].astype(bool)
        self.add_leaves, self.add_saved = get("add_leaves")[order], get("add_saved")[order]
        root_a, root_b = ka[order], kb[order]
        # Keys of a row's nodes by depth: the bitwise sum of the ids so far.
        self.key_a = np.bitwise_xor.accumulate(np.hstack([root_a[:, None], parts["a"][order]]), axis=1)
        self.key_b = np.bitwise_xor.accumulate(np.hstack([root_b[:, None], parts["b"][order]]), axis=1)
        change = np.ones((count, width + 1), bool)
        change[1:, 0] = (self.slab[1:] != self.slab[:-1]) | (root_a[1:] != root_a[:-1]) | (root_b[1:] != root_b[:-1])
        change[1:, 1:] = self.ids[1:] != self.ids[:-1]
        self.starts = np.logical_or.accumulate(change, axis=1)
        # A row's end is a leaf unless its conversation goes on or the next row has all its turns.
        last = np.append(self.starts[1:], np.ones((1, width + 1), bool), axis=0)
        self.leaf = last[np.arange(count), self.size] & ~self.more
        # Savings of a row at a depth and below: turns at which it is not the first of the node.
        saves = np.where(self.starts[:, 1:], 0, self.sizes)
        below = np.cumsum(saves[:, ::-1], axis=1)[:, ::-1]
        self.saved = np.hstack([below[:, :1] if width else np.zeros((count, 1), np.int64), below])
        self.width = width

    def nodes(self, depth: int, slab_size: int):
        """Values of the nodes at one depth: dict of columns, and (start, number of ends) of each."""
        start = np.flatnonzero(self.starts[:, depth])
        stop = np.append(start[1:], len(self.size))
        real = self.size[start] >= depth
        sums = lambda x: np.add.reduceat(x, start)
        child = self.starts[:, depth + 1] & (self.size > depth) if depth < self.width else np.zeros(len(self.size), bool)
        ends = sums(((self.size == depth) & ~self.more).astype(np.int64))
        hangs = (self.slab[start] > 0) & (depth == 0)  # the end of the slab before, counted there except for its children
        goes_on = sums(((self.size == depth) & self.more).astype(np.int64)) > 0
        flagged = (start == 0) | (stop == len(self.size)) | hangs | goes_on
        out = {
            "slab": self.slab[start], "depth": self.slab[start].astype(np.int64) * slab_size + depth, "ka": self.key_a[start, depth], "kb": self.key_b[start, depth],
            "conv": np.where(hangs, _NONE, np.minimum.reduceat(self.conv, start)), "n_convs": np.where(hangs, 0, stop - start), "n_children": sums(child.astype(np.int64)),
            "n_leaves": np.where(hangs, 0, sums(self.leaf + self.add_leaves)), "saved": np.where(hangs, 0, sums(self.saved[:, depth] + self.add_saved)), "flagged": flagged, "hangs": hangs,
        }
        return out, start, real, np.where(hangs, 0, ends)


def _empty(n: int) -> dict:
    return {name: [None] * n for name in _NAMES}


def _record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _ends(conv: np.ndarray) -> str:
    return ",".join(map(str, conv.tolist()))


def _parts(block: _Block, number: int, slab_size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Nodes, ends of flagged nodes and the first and last row of a block."""
    above = None
    for depth in range(block.width + 1):
        got, start, real, ends = block.nodes(depth, slab_size)
        at = np.flatnonzero(real)
        if not len(at):
            break
        out = _empty(len(at))
        for name in ("slab", "depth", "ka", "kb", "n_convs", "n_children", "n_leaves", "saved", "flagged"):
            out[name] = got[name][at]
        out["kind"], out["block"], out["at"] = ["node"] * len(at), [number] * len(at), [0] * len(at)
        out["conv"] = [None if x == _NONE else x for x in got["conv"][at].tolist()]
        if above is not None:
            up = np.searchsorted(above["start"], start[at], side="right") - 1
            out["pa"], out["pb"] = above["ka"][up], above["kb"][up]
            out["parent_conv"] = [None if f else c for f, c in zip(above["flagged"][up].tolist(), above["conv"][up].tolist())]
        flags = got["flagged"]
        out["ends"] = [NO_ENDS if not ends[i] else None if flags[i] else hashlib.sha256(_ends(block.conv[start[i] : start[i] + ends[i]]).encode()).hexdigest() for i in at]
        yield _record(out, schema)
        some = [(i, k) for i in at if ends[i] and flags[i] for k in range(0, ends[i], ENDS_PIECE)]
        if some:
            out = _empty(len(some))
            out["kind"], out["block"], out["at"] = ["ends"] * len(some), [number] * len(some), list(range(len(some)))
            for name in ("slab", "depth", "ka", "kb"):
                out[name] = [got[name][i] for i, _ in some]
            out["ends"] = [_ends(block.conv[start[i] + k : start[i] + min(k + ENDS_PIECE, ends[i])]) for i, k in some]
            yield _record(out, schema)
        above = got | {"start": start}
    yield _edges(block, number, schema)


def _edges(block: _Block, number: int, schema: pa.Schema) -> pa.RecordBatch:
    out = _empty(2)
    rows = [0, len(block.size) - 1]
    size = [int(block.size[r]) for r in rows]
    out |= {"kind": ["edge"] * 2, "block": [number] * 2, "at": [0, 1], "slab": block.slab[rows], "leaf": block.leaf[rows], "row_conv": block.conv[rows]}
    out["path_a"] = [block.key_a[r, : n + 1] for r, n in zip(rows, size)]
    out["path_b"] = [block.key_b[r, : n + 1] for r, n in zip(rows, size)]
    out["sizes"] = [block.sizes[r, :n] for r, n in zip(rows, size)]
    return _record(out, schema)


def _row_parts(block: _Block, number: int, slab_size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Leaves and savings of each row, and the first and last row of a block."""
    out = _empty(len(block.size))
    out |= {"kind": ["row"] * len(block.size), "slab": block.slab, "row_conv": block.conv, "n_leaves": block.leaf.astype(np.int64), "saved": block.saved[:, 0]}
    yield _record(out, schema)
    yield _edges(block, number, schema)


def _shards(rows: DataFrame, work, slab_size: int, block_rows: int) -> DataFrame:
    """``work`` on every block of the rows, which are sorted by range."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_PART))
    order = ["slab", "ka", "kb", "seq", "more", "conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, wait, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - held)
                batch, held = batch.slice(part.num_rows), held + part.num_rows
                wait.append(part)
                if held == block_rows:
                    yield from work(_Block(pa.Table.from_batches(wait)), number, slab_size, schema)
                    number, wait, held = number + 1, [], 0
        if held:
            yield from work(_Block(pa.Table.from_batches(wait)), number, slab_size, schema)

    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(spread.mapInArrow(run, _PART), "parts")


_FIX = "slab int, depth int, ka long, kb long, n_children long, n_leaves long, saved long, left_conv long, right_conv long"


def _corrections(parts: DataFrame, slab_size: int) -> DataFrame:
    """What neighbouring blocks counted twice, by node; depth 0 of a slab stands for rows of it (left, right) only.

    The first and last row of each block pass through one task in order; there are two for each block of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: dict[str, list] = {p.split()[0]: [] for p in _FIX.split(", ")}
            for row in batch.to_pylist():
                if row["at"] == 1:
                    last = row
                    continue
                if last is None or last["slab"] != row["slab"]:
                    continue
                keys = [list(zip(x["path_a"], x["path_b"])) for x in (last, row)]
                shared = next((d for d, (x, y) in enumerate(zip(*keys)) if x != y), min(map(len, keys))) - 1
                if shared < 0:
                    continue
                gone = last["leaf"] and shared == len(keys[0]) - 1
                saved = 0
                for d in range(shared, -1, -1):
                    saved += row["sizes"][d - 1] if d else 0
                    values = (row["slab"], row["slab"] * slab_size + d, *keys[1][d], -1 if d < shared else 0, -1 if gone else 0, saved, last["row_conv"], row["row_conv"])
                    for name, v in zip(out, values):
                        out[name].append(v)
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    edges = parts.where("kind = 'edge'").select("block", "at", "slab", "leaf", "row_conv", "path_a", "path_b", "sizes")
    return edges.coalesce(1).sortWithinPartitions("block", "at").mapInArrow(run, _FIX)


def _digests(parts: DataFrame) -> DataFrame:
    """ka, kb, depth, ends: the digest of flagged nodes' ends; a node's pieces stream through in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for key, text in zip(zip(*[batch[k].to_pylist() for k in ("ka", "kb", "depth")]), batch["ends"].to_pylist()):
                if key != now:
                    done += [(*now, digest.hexdigest())] if now else []
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            yield _named(done)
        yield _named([(*now, digest.hexdigest())] if now else [])

    def _named(done: list) -> pa.RecordBatch:
        cols = list(zip(*done)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["ka", "kb", "depth", "digest"])

    pieces = parts.where("kind = 'ends'").select("ka", "kb", "depth", "block", "at", "ends")
    pieces = pieces.repartition("ka", "kb", "depth").sortWithinPartitions("ka", "kb", "depth", "block", "at")
    return pieces.mapInArrow(run, "ka long, kb long, depth int, digest string")


def _with_later(rows: DataFrame, slab: int, block_rows: int) -> DataFrame:
    """``rows`` with the leaves and savings of the same conversation's later slabs."""
    none = F.lit(0).cast("long")
    plain = rows.withColumns({"add_leaves": none, "add_saved": none})
    later = plain.where("slab > 0")
    if not later.limit(1).count():
        return plain
    parts = _shards(later, _row_parts, slab, block_rows)
    fixes = _corrections(parts, slab).where(F.col("depth") == F.col("slab") * slab)
    found = parts.where("kind = 'row'").select(F.col("row_conv").alias("conv"), "slab", "n_leaves", "saved")
    found = found.unionByName(fixes.select(F.col("right_conv").alias("conv"), "slab", none.alias("n_leaves"), "saved"))
    found = found.unionByName(fixes.select(F.col("left_conv").alias("conv"), "slab", "n_leaves", none.alias("saved")))
    sums = found.groupBy("conv", "slab").agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
    # Rows of slab 0 take part with nothing of their own.
    sums = sums.unionByName(rows.where("slab = 0 and more").select("conv", "slab", none.alias("l"), none.alias("s")))
    after = Window.partitionBy("conv").orderBy(F.desc("slab")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "slab", F.coalesce(F.sum("l").over(after), none).alias("add_leaves"), F.coalesce(F.sum("s").over(after), none).alias("add_saved"))
    joined = rows.join(sums, ["conv", "slab"], "left")
    return written(joined.select(*rows.columns, F.coalesce("add_leaves", none).alias("add_leaves"), F.coalesce("add_saved", none).alias("add_saved")), "rows")


def trie(conversations: DataFrame, slab: int = SLAB, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Null roles and texts count as empty, null turns come first, repeated rows are turns of their own, rows without
    conv_id take no part; a rebuilt conversation without turns is a member of the root.  An empty table gives no rows,
    not even a root.  Other columns are not read.  Nodes are told apart by a 128-bit hash of their turns.
    """
    own = written(turns(conversations), "turns")
    rows = _with_later(_rows(rebuilt(own), slab), slab, block_rows)
    parts = _shards(rows, _parts, slab, block_rows)
    nodes = parts.where("kind = 'node'")
    values = ["n_convs", "n_children", "n_leaves", "saved"]
    key = ["ka", "kb", "depth"]
    none = F.lit(None)
    fixes = _corrections(parts, slab)
    # What stands at the top of a later slab is counted by the slab before, but for its children.
    top = (F.col("slab") > 0) & (F.col("depth") == F.col("slab") * slab)
    fixes = fixes.select(*key, none.cast("long").alias("pa"), none.cast("long").alias("pb"), none.cast("long").alias("conv"), none.cast("long").alias("parent_conv"), F.lit(0).cast("long").alias("n_convs"), "n_children", *[F.when(top, 0).otherwise(F.col(c)).alias(c) for c in ("n_leaves", "saved")])
    flagged = nodes.where("flagged").select(*key, "pa", "pb", "conv", "parent_conv", *values).unionByName(fixes)
    # A parent's member is known where the parent is not flagged: then all of it lies in one block.
    joint = flagged.groupBy(*key).agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("conv").alias("conv"), F.max("parent_conv").alias("parent_conv"), *[F.sum(c).alias(c) for c in values])
    joint = written(joint.join(_digests(parts), key, "left"), "joint")
    up = joint.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("up"))
    ends: Column = F.coalesce("digest", F.lit(NO_ENDS))
    shared = joint.join(up, ["pa", "pb", "depth"], "left").select("conv", "depth", F.coalesce("parent_conv", "up").alias("parent_conv"), *values, ends.alias("ends"))
    # Nodes below a flagged one find it among the flagged parts of their own block, so a hot parent is no hot key.
    by_block = nodes.where("flagged").select("block", "ka", "kb", "depth").join(joint.select(*key, F.col("conv").alias("up")), key)
    by_block = by_block.select("block", F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth"), "up").distinct()
    alone = nodes.where("not flagged").join(by_block, ["block", "pa", "pb", "depth"], "left")
    alone = alone.select("conv", "depth", F.coalesce("parent_conv", "up").alias("parent_conv"), *values, "ends")
    return shared.unionByName(alone).select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )
