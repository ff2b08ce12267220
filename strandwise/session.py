"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "strandwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (AQE with skew joins, UTC).

    Settings already present, for example from ``spark-submit``, can be passed again
    through ``conf``; nothing here fixes a cluster size.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder, taken from ``spark.checkpoint.dir``.

    A machine-local folder is made up only for a local master, where the driver's disk
    is also every executor's disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="strandwise-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame, *folders: str) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and continue from there.

    Used where a later stage must see the very same rows even if executors are lost, and
    where a result is read more than once. Columns are pruned when it is read; with
    ``folders`` so are the folders of these columns.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*folders) if folders else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a settled table, as the planner sees them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_bytes(spark: SparkSession) -> int:
    """The bytes up to which Spark broadcasts a table on its own; below 0 for never."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    return int(text[:-1]) << units[text[-1]] if text[-1:] in units else int(text)


@contextmanager
def arrow_rows(spark: SparkSession, row_bytes: int, batch_bytes: int = 32 << 20) -> Iterator[None]:
    """For jobs run inside: batches that go to Python have about ``batch_bytes``, not a number of
    rows that wide rows make too large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(before), batch_bytes // max(row_bytes, 1)))))
    try:
        yield
    finally:
        spark.conf.set(name, before)
