"""Session helpers: a local session for tests, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siftmill")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the session is local
    (tests, notebooks) a folder of this machine is taken instead.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"siftmill-{os.getpid()}")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing that another run wrote is met there. What an application writes under
    such paths is deleted when its driver ends."""
    application = spark.sparkContext.applicationId
    if application not in _ENDING:
        _ENDING.add(application)
        atexit.register(_delete, *_folder(spark))
    return f"{shared_dir(spark)}/siftmill/{application}/{name}-{uuid.uuid4().hex[:12]}"


#: Applications whose tables are deleted at the end.
_ENDING: set[str] = set()


def _folder(spark: SparkSession) -> tuple[Any, Any]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/siftmill/{spark.sparkContext.applicationId}")
    return path, spark.sparkContext._jsc.hadoopConfiguration()


def _delete(path: Any, configuration: Any) -> None:
    try:
        path.getFileSystem(configuration).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; its folder is then left behind
        return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and
    survives the loss of any executor."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where the layout of its files gives fewer tasks than there are cores: for work that costs far
    more than moving such a small input. An input of as many tasks stays as it is, as does one that comes out of a shuffle
    (to ask how many tasks it has would run it)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "AdaptiveSparkPlan" in plan or "Exchange" in plan:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only when the size is proven; otherwise the optimizer's shuffle join stays."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def clear_tables(spark: SparkSession) -> None:
    """Delete now what this application wrote to the shared folder; results that read it are no longer valid."""
    path, configuration = _folder(spark)
    path.getFileSystem(configuration).delete(path, True)


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """``rows`` with their place from 0 in the order they have (of their files, or after ``orderBy``): rows of each task are counted,
    and numbered from where the tasks before it end. No task numbers all."""
    at = materialise(rows.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}), "numbered")
    counts = at.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.select("__p", (F.sum("n").over(W.orderBy("__p")) - F.col("n")).alias("__s"))  # one row a task
    nth = F.row_number().over(W.partitionBy("__p").orderBy("__m")) - 1
    return at.withColumn("__r", nth).join(broadcast_if_small(before), "__p").withColumn(out, F.col("__s") + F.col("__r")).drop("__p", "__m", "__s", "__r")
