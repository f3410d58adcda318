"""Session settings, lineage cuts and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its measured size stays below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def build_session(app: str = "sweeplog", cores: int | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on. Cluster settings given from outside win."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders made for sessions without spark.checkpoint.dir, by application.
_OWN_DIRS: dict[str, str] = {}


# Tables written for an application's jobs, until they are discarded.
_STAGED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's spark.checkpoint.dir. In local mode a fresh one where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="sweeplog-")
    return _OWN_DIRS[app]


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that two stages must read identically."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_staged(spark: SparkSession) -> int:
    """Delete what this application's jobs have staged; to be called when their results are written. Says how many tables went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    gone = 0
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a parquet table in the shared folder and read it back.

    For intermediate results that several steps use: they are computed once, later reads prune columns, and a lost
    executor costs a re-read.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Size of a frame by summing the text form of each row; one aggregate pass, one number back."""
    row_size = F.length(F.to_json(F.struct(*df.columns))) + F.lit(32)
    return int(df.agg(F.coalesce(F.sum(row_size), F.lit(0)).alias("n")).first()["n"])


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    spread: list[str] | None = None,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    salts: int = 32,
    stored: bool = False,
) -> DataFrame:
    """Join a large frame to a side that is normally small.

    The small side is computed once, written (unless it is a `stored` table already), and measured. Below the limit it is broadcast and the large side does not move.
    Above it both sides shuffle on the key plus a salt taken from the large side's `spread` columns,
    with the small side repeated once per salt, so a key that owns a third of all rows is cut in `salts`. Such a join is asked to merge:
    Spark takes the size of the small side's files for that of its repeated rows, and would broadcast them.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the large side must be kept whole; {how!r} is not supported")
    small = small if stored else materialize(small, "small-side")
    if estimated_bytes(small) <= limit_bytes:
        return big.join(F.broadcast(small), on, how)
    if not spread:
        return big.join(small.hint("merge"), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")
