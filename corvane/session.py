"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; ``conf`` overrides single settings."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints are deleted once nothing refers to them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written on the way: the one named in ``spark.checkpoint.dir``.

    Only where that is unset and the master is a local one (tests, benches) is a temporary folder made; a cluster without the
    setting is an error, for a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corvane-checkpoint-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# Fixed value: seconds between releases; what less time shuffles is little.
_RELEASE_S = 3
_released = [0.0]


def release(spark: SparkSession, now: bool = False) -> None:
    """Have the files of shuffles deleted that nothing refers to any more; Spark finds them only when the driver collects its garbage."""
    if now or time.monotonic() - _released[0] >= _RELEASE_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


def write_packed(df: DataFrame, path: str) -> None:
    """Write a table on the way as small as it gets, and release what its making shuffled."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    release(df.sparkSession)


def stored_once(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name``, built at its first use in an application and read from the shared folder from then on.

    It belongs to the state of the ``sources`` it is built from: files of another length or time make another table. A table
    that isn't whole is built again.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    state = []
    for source in sources:
        files = hadoop(source).getFileSystem(conf)
        about = files.getContentSummary(hadoop(source))
        state.append(f"{source} {about.getLength()} {about.getFileCount()} {files.getFileStatus(hadoop(source)).getModificationTime()}")
    mark = hashlib.sha256("\n".join(state).encode()).hexdigest()[:16]
    path = f"{shared_folder(spark)}/stored/{name}-{mark}"
    if not hadoop(path).getFileSystem(conf).exists(hadoop(f"{path}/_SUCCESS")):
        write_packed(build(), path)
        # few tables are stored, and the next one shuffles as much
        release(spark, now=True)
    return spark.read.parquet(path)
