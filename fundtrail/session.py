"""Session settings the engine relies on, and the tables it writes to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join keys even where the split costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A bucket of one file is read as sorted, so joins and groups by its key sort the other side only.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}

#: Whether Spark plans a write's sort together with the query, where it takes the place of a sort of the query's own.
PLANNED_WRITE = "spark.sql.optimizer.plannedWrite.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for iteration tables, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with the machine, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fundtrail-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/fundtrail/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables this application wrote, once no result needs them any more."""
    remove_path(spark, _scratch_root(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """Buckets of a stored table: as many as shuffles have partitions, so that a join moves its other side only."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, key: list[str], n: int | None = None, dealt: bool = False) -> DataFrame:
    """Store ``df`` in ``path`` dealt by ``key``, one file for each of ``n`` buckets, and read it back as such.

    Joins and groups by ``key`` find the rows of a key in one bucket and need no exchange on this side. The result of a
    join or group by ``key`` lies that way already (``dealt``) and is written where it is, without an exchange.
    """
    spark, n = df.sparkSession, n or buckets(df.sparkSession)
    # The write sorts by bucket number and key, and works out the numbers anew for every two rows it compares. Rows that come
    # sorted by key take it one comparison each, so they are sorted ahead, where keys are compared as such.
    rows = (df if dealt else df.repartition(n, *key)).sortWithinPartitions(*key)
    planned = spark.conf.get(PLANNED_WRITE)
    spark.conf.set(PLANNED_WRITE, "false")
    try:
        rows.write.bucketBy(n, *key).sortBy(*key).option("path", path).format("parquet").saveAsTable(name := _table_name())
    finally:
        spark.conf.set(PLANNED_WRITE, planned)
    return spark.table(name)


def read_bucketed(spark: SparkSession, path: str, columns: str, key: list[str], n: int) -> DataFrame:
    """A folder that :func:`write_bucketed` has written, also by another application; an empty table has no file to tell its columns."""
    name, keys = _table_name(), ", ".join(key)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def materialize_bucketed(df: DataFrame, name: str, key: list[str], n: int | None = None, dealt: bool = False) -> DataFrame:
    """Like :func:`materialize`, dealt by ``key``."""
    return write_bucketed(df, scratch_path(df.sparkSession, name), key, n, dealt)


def _table_name() -> str:
    return f"fundtrail_{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core ahead of costly work on every row.

    A small file comes as one or two partitions and is dealt out; a large table already has
    more partitions than that and passes unchanged, without an exchange.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def by_shuffle(table: DataFrame) -> DataFrame:
    """Have a join deal ``table`` out by key, whatever its files' size.

    Spark judges a table by the bytes of its files and the share of them that the columns read have by their types. Flags,
    nulls and short sets take far less room in a file than in memory, so a table with a row per wallet can pass for a small
    one and be sent whole through the driver.
    """
    return table.hint("merge")


def path_exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
