"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that an operator sends to every executor at once.
BROADCAST_BYTES = 64 << 20

#: Rows and bytes of a batch between Spark and Python: what a worker holds beside its own arrays.
ARROW_ROWS = 1_000
ARROW_BYTES = 8 << 20

_fallback: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where it is unset on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="palimpsest-")
    return f"file://{_fallback[app]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its folder is the cluster's to clean
        return


def give_back() -> None:
    """Returns free memory of a worker to the machine, as workers are used again by later tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes, "CDLL") and sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as written to, and read from, a Parquet table in the shared folder.

    This cuts the lineage: a lost executor costs a new read, not a new computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palimpsest/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    read = spark.read.schema(df.schema).parquet(path)
    _paths[read] = path
    return read


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            _remove(df.sparkSession, path)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes in which the session sends texts to Python, unless they are lower already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns, cast; extra columns of any name are left out at the scan."""
    bounded_batches(df.sparkSession)
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in columns.items()))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges can reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges stay the same.  Every step is a grouped minimum, combined before the
    shuffle, and an equi-join whose large keys Spark can split; no neighbour
    list is ever gathered.  Nodes without an edge to another node are absent.
    """
    edges = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a <> b")
        last, edges = edges, stored(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(last)
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
