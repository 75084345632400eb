"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keyed state lives on disk and is checkpointed by changes, not as whole maps
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # sources written in Python then end a bounded run with the batch that closes what is due
    "spark.sql.streaming.triggerAvailableNowWrapper.enabled": "true",
    # by default every folder of a large tree is listed by a task of its own, which takes longer to start than to list
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    # HotSpot does not compile methods above 8000 bytes of bytecode.  Fused stages with
    # many regex columns exceed that and would run interpreted; below the limit Spark
    # compiles the operators one by one instead (event_features at sf0.1: 3.4 s -> 2.3 s).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (UTC clock, AQE)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def session_with(spark: SparkSession, settings: dict[str, int | str]) -> SparkSession:
    """A session on the same context with the settings of this one and more, which hold for its frames alone."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if other.conf.isModifiable(key):
            other.conf.set(key, value)
    for key, value in settings.items():
        other.conf.set(key, value)
    return other


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Single-node session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("emberwatch")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only when a local session names none is a temporary one chosen, and it is then
    registered with the session so later calls agree.  On a cluster each executor would
    write to its own disk, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="emberwatch-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing path under the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a small intermediate feeds several branches or fixes a
    partition-dependent value: the copy survives executor loss, and its file size
    gives the planner a real statistic for choosing the join.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, purpose)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    place, store = _place(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package wrote."""
    place, store = _place(spark, path)
    store.delete(place, True)
