"""Session helpers: one place for the configuration every entry point shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "replytime",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the benchmark.

    On a cluster, the session comes from the launcher and none of these
    settings are forced; the library only reads them.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no per-call Python call-site capture: building a Hessian's hundreds of
        # Column expressions would otherwise cost several JVM round trips each
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # HotSpot does not JIT-compile methods over 8000 bytecodes: a fused stage
        # whose generated method is larger would run interpreted, so such stages
        # leave whole-stage codegen instead (the value Spark's docs suggest)
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    The setting is read from the session and used as is; on a cluster it must
    name a folder that the driver and all executors share.  Only a session
    on one machine (a ``local`` master, as in tests) may leave it unset: it
    then gets a folder of its own.  Any other session without it is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="replytime-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named
