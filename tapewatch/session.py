"""Session settings, the shared scratch folder and reliable lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows up to which a side table may be broadcast; always compared with a count.
BROADCAST_ROWS = 500_000


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call-site look-up per expression
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: every
    executor must be able to read what another one wrote here.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tapewatch-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and drop its lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that broadcasts neither side, whatever Spark takes their sizes for.

    Spark's estimates don't count the rows that an explode makes: a side of many times the limit can pass for a small one.
    """
    return df.hint("merge")


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if counting proves it small, else let the join broadcast neither side.

    The count is a job of its own, so ``df`` should be cheap to read.
    """
    return F.broadcast(df) if df.count() <= limit else shuffled(df)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application.

    The archive is handed to Spark, which serves it to every executor.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    target = os.path.join(tempfile.mkdtemp(prefix="tapewatch-"), name)
    context.addPyFile(shutil.make_archive(target, "zip", root, name))
    _SHIPPED.add(context.applicationId)
