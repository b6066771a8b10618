"""Session helpers: shared working folder, written intermediate tables, broadcast decisions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "tracksmith", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent a fresh local folder is set, and only on one machine: a cluster needs a shared one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if not have:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        have = spark.sparkContext.getCheckpointDir()
    return have.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    # Spark 4.1 zips the sides of a union that it takes for equally dealt, and fails where adaptive execution has made them unequal
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Column and number of buckets by which written tables are dealt; none outside dealt_by().
_DEALT: ContextVar[tuple[str, int] | None] = ContextVar("dealt", default=None)
#: Rows of the input that a bucket is meant for.
BUCKET_ROWS = 500_000


@contextmanager
def dealt_by(spark: SparkSession, key: str, n: int) -> Iterator[None]:
    """Tables with the key that are written inside are bucketed by it: joins, aggregates and windows whose keys hold it shuffle nothing.

    All rows of one key meet in one task, so this is for keys of bounded size (events). Results don't depend on it.
    """
    for conf in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.sources.bucketing.autoBucketedScan.enabled"):
        spark.conf.set(conf, "false")
    token = _DEALT.set((key, n))
    try:
        yield
    finally:
        _DEALT.reset(token)


def dealt_like(key: str, source: Callable[[SparkSession, str], DataFrame], rows: int = BUCKET_ROWS) -> Callable:
    """Decorator of queries (session, folder): they run inside dealt_by(), with a bucket for each so many rows of the source."""

    def decorate(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(query)
        def run(spark: SparkSession, d: str) -> DataFrame:
            n = max(spark.sparkContext.defaultParallelism, -(-source(spark, d).count() // rows))
            with dealt_by(spark, key, n):
                return query(spark, d)

        return run

    return decorate


def is_dealt(df: DataFrame) -> bool:
    """Whether tables with df's columns are written in buckets."""
    by = _DEALT.get()
    return by is not None and by[0] in df.columns


def together(df: DataFrame) -> DataFrame:
    """df dealt as the written tables are, if they are dealt: one shuffle in place of one for each step that follows."""
    return df.repartition(_DEALT.get()[1], _DEALT.get()[0]) if is_dealt(df) else df


def written(df: DataFrame | list[DataFrame], name: str = "table") -> DataFrame:
    """Write df (or several of equal columns) as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Inside dealt_by() the table is bucketed; several are written one after the other, so that dealt ones are not shuffled for it.
    """
    parts = df if isinstance(df, list) else [df]
    spark, schema, path = parts[0].sparkSession, parts[0].schema, fresh_path(parts[0].sparkSession, name)
    if not is_dealt(parts[0]):
        reduce(DataFrame.unionByName, parts).write.parquet(path)
        return spark.read.schema(schema).parquet(path)
    (key, n), table = _DEALT.get(), f"{name}_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"create table {table} ({columns}) using parquet clustered by (`{key}`) into {n} buckets location '{path}'")
    for p in parts:
        together(p.select(*schema.names)).write.insertInto(table)
    return spark.table(table)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """True if df has at most most_rows rows; reads no more than one row beyond the bound."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it is proven to hold at most most_rows rows, else df as it is (a shuffled join)."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


def bounded_batches(spark: SparkSession, rows: int = 1024, megabytes: int = 4) -> None:
    """Keep Arrow batches small by rows and by bytes, so that a batch of long values fits a Python worker; settings only go down."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))
