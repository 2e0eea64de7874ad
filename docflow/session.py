"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# AQE sizes the shuffles and splits skewed join partitions at run time; the
# static values below only matter where the session sets none.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}

# Shuffle files of a finished write are of no use any more; without this they stay until the driver
# happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Intermediate tables: small row groups, so that a reader's batch holds a few long texts only.
LAYOUT = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "10"}
# Work folders that were named while tables are being `kept`.
_INNER: ContextVar[list[str] | None] = ContextVar("inner folders", default=None)


def local_session(app: str = "docflow", cores: str | int = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own.

    Counts and index pairs are small but costly to fold, so locally even small shuffle
    partitions stay apart.
    """
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
               .config("spark.sql.shuffle.partitions", str(partitions)))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="docflow-checkpoint-")
    sc.setCheckpointDir(folder)


def work_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, for logs that rounds append to."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}"
    if (inner := _INNER.get()) is not None:
        inner.append(folder)
    return folder


def small(df: DataFrame, rows: int, limit: int = 10_000) -> DataFrame:
    """Broadcast a table built on the driver, if its known row count is small; above the
    limit Spark picks the join by its own size estimates."""
    return F.broadcast(df) if rows <= limit else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder.

    Used between rounds (repair, tools, tree levels): a round is computed once,
    and a lost executor re-reads files instead of repeating model calls.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path``, compressed, and go on from the files. No shuffle files of the write are left."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.options(**LAYOUT).parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, in compressed files that are read by column. They go when the `kept` tables they were
    stored for are written."""
    return written(df, work_folder(df.sparkSession))


class Kept(tuple):
    """Tables in files of their own, until ``drop``."""

    folders: list[str]

    def drop(self) -> None:
        for df, folder in zip(self, self.folders):
            _delete(df.sparkSession, folder)


def kept(make: Callable[[], Iterable[DataFrame]]) -> Kept:
    """The tables ``make`` gives, in files. Whatever was ``stored`` while they were made, in operators too, is deleted
    as soon as they are written, so a chain of steps has the files of one or two of them on disk and not of all."""
    inner: list[str] = []
    token = _INNER.set(inner)
    frames: list[DataFrame] = []
    made: list[str] = []
    try:
        for df in make():
            frames.append(df)
            ensure_checkpoint_dir(df.sparkSession)
            made.append(f"{df.sparkSession.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}")
            frames[-1] = written(df, made[-1])
    finally:
        _INNER.reset(token)
        for folder in inner if frames else ():
            _delete(frames[0].sparkSession, folder)
    out = Kept(frames)
    out.folders = made
    if (outer := _INNER.get()) is not None:
        outer.extend(made)
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
