"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 8_000_000
#: With it Spark removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and every executor reach: ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end in it leave no shuffle files.  For those that are run once: another run would shuffle anew."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(df: DataFrame, *more: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once nothing that is still to run reads them."""
    for table in (df, *more):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name where a column is already called so."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def column(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def content_key(text: Column) -> Column:
    """128 bits that stand for a text, null for empty; the same in every scan, whatever the splits of files."""
    plain = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(plain).alias("k1"), F.xxhash64(F.lit(1), plain).alias("k2"))


def keep_rows(docs: DataFrame, judged: DataFrame, key: Column) -> DataFrame:
    """Rows of ``docs`` that ``judged`` says to keep; all columns unchanged.

    ``judged`` has a row (doc_id, key, stay) for each row of ``docs``.  Rows are told apart by id and content (``key`` of
    the text column), never by a number that another scan might deal out differently: files are split by the cores that
    are there at the time.  Rows that agree in both are copies with one id, of which at most one may stay; the smallest
    by a hash of all columns does.
    """
    k, i = free_name(docs, "_key"), free_name(docs, "_id")
    stay = judged.groupBy(F.col("doc_id").alias(i), F.col("key").alias(k)).agg(F.max("stay").alias("stay"), F.count("*").alias("copies")).where("stay")
    stay = written(stay.select(i, k, "copies"), "stay")
    tagged = docs.withColumn(k, key)

    def chosen(which: DataFrame) -> DataFrame:
        ids = which.select(F.col(i).alias("_right_id"), F.col(k).alias("_right_key"))
        on = column(tagged, "doc_id").eqNullSafe(ids["_right_id"]) & (column(tagged, k) == ids["_right_key"])
        return tagged.join(ids, on, "left_semi")

    names = [f"`{c}`" for c in docs.columns]
    if not stay.where("copies > 1").limit(1).count():
        return chosen(stay).select(*names)
    one = Window.partitionBy("doc_id", k).orderBy(F.xxhash64(*names))
    again = chosen(stay.where("copies > 1")).withColumn(i, F.row_number().over(one)).where(F.col(i) == 1)
    return chosen(stay.where("copies = 1")).select(*names).unionByName(again.select(*names))


def map_arrow(df: DataFrame, schema: str | StructType, work: Callable[[pa.RecordBatch], dict], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``work`` turns each Arrow batch into a dict of columns with the names and order of ``schema``.

    It gets slices of about ``slice_bytes``, so that a task's memory does not follow the length of the texts in a batch.
    """
    types = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    owner = work.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(owner)
        for batch in batches:
            rows = max(1, batch.num_rows * slice_bytes // max(slice_bytes, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in types], schema=types)
            del batch
        _give_back()

    return df.mapInArrow(run, schema)


_owner: list[str] = []


def _begin(owner: str) -> None:
    """Workers outlive stages: what another operator has kept in this one goes."""
    if _owner != [owner]:
        _owner[:] = [owner]
        pa.set_memory_pool(pa.system_memory_pool())  # what it frees can be given back
        _held.clear()
        tables.clear()
        _give_back()


def _give_back() -> None:
    """Returns freed memory to the system, so that an idle worker does not hold the peak of its last task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


_held: dict[tuple, object] = {}
#: Tables that several operators compute and keep, such as powers of a base.
tables: dict[str, object] = {}


def held(key: tuple, build: Callable[[], object]):
    """What ``build`` gives, kept in the worker for its next batches; a worker keeps one such thing at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def tie(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): every id in them with ``root``, the smallest id it reaches.

    Alternating large-star and small-star rounds: each round moves links towards smaller ids and is one or two shuffles
    on (id, id) rows; the number of rounds grows with the logarithm of the longest chain.  Hot ids are safe: minima are
    partial aggregates and the join back is split by Spark where one id has many links.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Each neighbour below u, and u itself, goes to the smallest of them.
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.*").where("u <> v").distinct(), "links")
        with shuffles_removed(links.sparkSession):
            moved = after.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        discard(edges)
        edges = after
        if not moved:
            break
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
