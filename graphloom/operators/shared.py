"""The folder that all executors share, and the tables that cut lineage there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made here, by application; and all that is to be deleted at exit.
_own: dict[str, str] = {}
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where that is unset a session on one machine gets a temporary folder; on a
    cluster there is no folder to guess, so that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or _own.get(sc.applicationId)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    _made[at] = spark
    return at


def drop_path(spark: SparkSession, at: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(at, None)


def _clean() -> None:
    for at, spark in list(_made.items()):
        try:
            drop_path(spark, at)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


atexit.register(_clean)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    _made[at] = spark
    out = spark.read.schema(df.schema).parquet(at)
    out._table = at
    return out


def spread(df: DataFrame) -> int:
    """Partitions for work that is heavier than its bytes: adaptive execution would put rows of few bytes into one task."""
    return max(df.sparkSession.sparkContext.defaultParallelism * 3, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def discard(df: DataFrame) -> None:
    """Deletes the table that materialize wrote for df; nothing that reads it may be left."""
    if at := df.__dict__.get("_table"):
        drop_path(df.sparkSession, at)
