"""Session defaults and the shared working folder."""

import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # State with maps and timers needs it.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options the jobs rely on; sizes stay with the cluster."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cpus: int | str = "*", shuffle_partitions: int = 8, **options: str
) -> SparkSession:
    """Session for tests and the benchmark; ``options`` by Spark key."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docketry")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**DEFAULTS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for written tables and streaming state.

    It lies under ``spark.checkpoint.dir``, which a cluster sets to shared
    storage.  Where that is unset, it lies in the warehouse.  A warehouse that is
    a folder of the driver will do in local mode only; on a cluster it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.work"
        here = root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local")
        if here or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
