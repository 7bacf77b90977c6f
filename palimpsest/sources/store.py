"""Written tables: intermediate ones in the shared folder, and the log's."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset on one machine."""
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
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its folder is the cluster's to clean
        return


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as part of the plan: no tasks run to read them, and Spark knows their size."""
    kind = T._parse_datatype_string(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind)
    table = pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind, strict=True)], names=kind.names)
    return spark.createDataFrame(table, kind)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as written to, and read from, a Parquet table in the shared folder; this cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palimpsest/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
