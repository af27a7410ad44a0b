"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark import SparkContext
from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
IDENTIFIER_CONF = "spark.sql.ansi.doubleQuotedIdentifiers"


def build_session(app: str = "tallymark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ANSI casts, UTC timestamps and adaptive execution on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # The JVM leaves longer methods interpreted; such a stage is better run operator by operator.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Recording a call site per expression costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def quoted_identifiers(spark: SparkSession) -> Iterator[None]:
    """Read ``"name"`` as a column, not as text, while a user's SQL is analysed."""
    before = spark.conf.get(IDENTIFIER_CONF, "false")
    spark.conf.set(IDENTIFIER_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(IDENTIFIER_CONF, before)


_made: list[str] = []


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a session in one process that
    names none, as in tests, gets a folder of its own; on a cluster that is an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set(CHECKPOINT_CONF, root)
    if not _made:
        atexit.register(drop_scratch)
    _made.append(os.path.join(root, f"{purpose}-{uuid.uuid4().hex}"))
    return _made[-1]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder, when no frame that reads it is used any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.remove(path)


def drop_scratch() -> None:
    """Delete every scratch folder of this process; frames that read one can't be used after that.

    Called when the process ends, and by a long-lived driver once its results are written.
    """
    gateway = SparkContext._gateway
    while _made and gateway is not None:
        with suppress(Exception):  # the JVM may be gone already
            path = gateway.jvm.org.apache.hadoop.fs.Path(_made.pop())
            path.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
