"""Session set-up: workers that can import this package, and the folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes of an Arrow batch at most: workers hold a few batches at once, what they make of them is larger, and texts may be long.
BATCH_BYTES = 8 << 20


def prepare_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed, and bound their batches by bytes. On a cluster, install it
    or ship it with --py-files."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: the one named in ``spark.checkpoint.dir``. Only a session in a single
    process (as in tests), where a temporary folder is seen by all, gets one of its own if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if not named and context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not named:
        if not context.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="vectrine-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        named = f"file://{named}"
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables go."""
    return f"{shared_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
