"""Session, storage and partitioning helpers shared by all operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: str | None = None
#: Folder of this run's tables, below the shared one.
_RUN = f"run-{uuid.uuid4().hex}"
_USED: dict[str, SparkSession] = {}


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("segloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def session(app: str = "segloom", **conf: str) -> SparkSession:
    """The session that the launcher configures (master, executors, shared folder), with the
    settings the operators rely on unless it says otherwise."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where the session names none (tests, a laptop) a temporary folder is made and set.
    """
    global _LOCAL_DIR
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="segloom-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_LOCAL_DIR)
    return _LOCAL_DIR


def run_dir(spark: SparkSession) -> str:
    """The folder of this run's tables in the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/segloom/{_RUN}"
    if path not in _USED:
        if not _USED:
            atexit.register(clear_tables)
        _USED[path] = spark
    return path


def clear_tables() -> None:
    """Deletes the tables this run has written to shared folders. Frames that read them can't be
    used any more; new ones may be made."""
    while _USED:
        path, spark = _USED.popitem()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone; a local folder can still go
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and return it without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Preferred to `cut` for wide or large intermediates: columnar, compressed, and its real
    size is known to the optimizer, so a join on it is broadcast only if it is small.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one file through Hadoop's file systems, so the folder may be any it knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for begin in range(0, len(content), 1 << 20):
            stream.write(bytearray(content[begin : begin + (1 << 20)]))
    finally:
        stream.close()


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(rows: int, per_block: int, spark: SparkSession, least: int = 1) -> int:
    """Number of blocks of about `per_block` rows, and at least `least`."""
    return max(least, math.ceil(rows / per_block))


def digest(*cols: Column | str) -> Column:
    """128-bit key of the given string columns (nulls and empty strings differ), as 16 bytes."""
    parts = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts.append(F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")))
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


WHITE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """The text without surrounding Unicode white space."""
    return F.regexp_replace(c, WHITE, "")


def blank(c: Column) -> Column:
    """True for null, empty and white-space-only texts."""
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))
