"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes.  Equal blocks get one integer name: blocks are shuffled by hash,
sorted, and numbered run by run, comparing the bytes themselves.  Adjacent names of a document are then paired, and
equal pairs are named the same way, until each document has a single name.  Two documents of as many blocks have the
same name exactly when their texts are equal; no fingerprint takes part in that decision.

Scale: each text is shuffled once.  A block that repeats within an Arrow batch is sent once for the batch, so a text
that makes up a third of the corpus does not fill one task; later rounds carry integers only, name distinct pairs
(combined before the shuffle) and halve every time.  A retried task gets the same names, since they follow from the
sorted order alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from inspectlake.llm.common import as_bytes, column, keep_rows, map_arrow, written

_BLOCKS = "uid long, doc_id long, pos int, n_blocks int, sha string, rep_uid long, rep_pos int, block binary"


def _cut(size: int):
    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("uid", "doc_id", "pos", "n_blocks", "sha", "rep_uid", "rep_pos", "block")}
        first: dict[bytes, tuple] = {}
        for uid, doc, text in zip(batch["uid"].to_pylist(), batch["doc_id"].to_pylist(), as_bytes(batch["text"])):
            n = max(1, -(-len(text) // size))
            sha = hashlib.sha256(text).hexdigest()
            for pos in range(n):
                block = text[pos * size : (pos + 1) * size]
                rep = first.setdefault(block, (uid, pos))
                new = rep == (uid, pos)
                for name, value in zip(out, (uid, doc, pos, n, None if pos else sha, *rep, block if new else None)):
                    out[name].append(value)
        return out

    return work


def _name_runs(df: DataFrame, key: list[str], keep: list[str], kinds: str) -> DataFrame:
    """``keep`` columns plus ``name``: rows with equal ``key`` get one integer, others another."""
    spread = df.repartition(*key) if len(key) > 1 else df.withColumn("_h", F.xxhash64(*key)).repartition("_h")
    order = key if len(key) > 1 else ["_h", *key]
    rows = spread.sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = -1, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = None
            for k in key:
                col = batch[k]
                differs = pc.not_equal(col[1:], col[:-1])
                change = differs if change is None else pc.or_(change, differs)
            here = tuple(batch[k][0].as_py() for k in key)
            starts = [here != last, *change.to_pylist()]
            names = []
            base = batch["_p"][0].as_py() << 40
            for s in starts:
                count += s
                names.append(base + count)
            last = tuple(batch[k][n - 1].as_py() for k in key)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keep], pa.array(names, pa.int64())], names=[*keep, "name"])

    return rows.mapInArrow(run, f"{kinds}, name long")


def block_names(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """One row per row of ``docs`` (uid, doc_id, text): uid, doc_id, sha, level, name; (level, name) identifies the text.

    A null text counts as empty; the empty text is one block of no bytes and has a name like any other.
    """
    blocks = map_arrow(docs.select("uid", "doc_id", "text"), _BLOCKS, _cut(block_bytes))
    named = _name_runs(blocks.where("block is not null").select("rep_uid", "rep_pos", "block"), ["block"], ["rep_uid", "rep_pos"], "rep_uid long, rep_pos int")
    rows = blocks.drop("block").join(named, ["rep_uid", "rep_pos"]).drop("rep_uid", "rep_pos")
    rows = written(rows, "names")
    done = rows.where("n_blocks = 1").select("uid", "doc_id", "sha", F.lit(0).alias("level"), "name")
    most = rows.agg(F.max("n_blocks")).first()[0] or 0
    rest, level = rows.where("n_blocks > 1"), 0
    while 2**level < most:
        level += 1
        half = F.expr("pos div 2").cast("int")
        left, right = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = rest.groupBy("uid", "doc_id", "n_blocks", half.alias("pos")).agg(F.max("sha").alias("sha"), F.max(left).alias("l"), F.coalesce(F.max(right), F.lit(-1)).alias("r"))
        names = _name_runs(pairs.select("l", "r").distinct(), ["l", "r"], ["l", "r"], "l long, r long")
        rest = written(pairs.join(names, ["l", "r"]).drop("l", "r"), "names")
        ends = F.col("n_blocks") <= 2**level
        done = done.unionByName(rest.where(ends).select("uid", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        rest = rest.where(~ends)
    return done


def exact_groups(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """Per row of ``docs`` (uid, doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, uid.

    Of rows with equal texts that with the largest doc_id stays; of rows that also share it, one stays.  A null id is
    smaller than any other.  An empty table gives no rows.
    """
    names = block_names(docs, block_bytes)
    groups = names.groupBy("level", "name").agg(F.max(F.struct("doc_id", "uid")).alias("last"), F.count("*").alias("group_size"))
    return names.join(groups, ["level", "name"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("last.uid")).alias("kept"), F.col("sha").alias("text_sha256"), "uid"
    )


def exact_dedup(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """Rows of ``docs`` without exact copies, all columns unchanged."""
    groups = exact_groups(numbered(docs), block_bytes).select("doc_id", F.col("text_sha256").alias("key"), F.col("kept").alias("stay"))
    return keep_rows(docs, groups, F.sha2(F.coalesce(column(docs, "text"), F.lit("")), 256))


def numbered(docs: DataFrame) -> DataFrame:
    """uid, doc_id and text of a documents table.

    The number holds within one job; what is read again later is told apart by its content.
    """
    return docs.select(F.monotonically_increasing_id().alias("uid"), column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))
