"""Session construction and cluster-level settings.

Everything in the library is lazy DataFrame code; this module only decides
how a session is configured when the caller does not bring one, and where
lineage is cut when a job needs to survive executor loss.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library relies on.  AQE decides broadcast versus
# sort-merge from the *measured* size of a finished shuffle stage, coalesces
# small partitions and splits skewed ones; nothing here pins a physical plan.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


#: Drops an execution's shuffle files when it ends, instead of when the driver collects its handles.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "cohortcraft",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session with the engine settings applied.

    ``master`` is only given for local runs (tests, bench); on a cluster the
    launcher supplies it.  ``shuffle_partitions`` should follow the data size:
    about 2-3x the executor cores for local data, and input-bytes / 128 MB
    for cluster runs (AQE then coalesces what turns out small).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(ENGINE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.ui.enabled", "false")
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001  (Spark Connect)
        pass
    return spark


def apply_engine_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable engine settings to an existing session."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session; keep the cluster's value
            pass
    return spark


@lru_cache(1)
def _local_checkpoints() -> str:
    return tempfile.mkdtemp(prefix="cohortcraft-ckpt-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Read from ``spark.checkpoint.dir``; only a local session may go without
    it and then gets a folder of its own, elsewhere that is an error (a
    machine-local folder would lose data).  The folder is also
    registered with the SparkContext so ``DataFrame.checkpoint`` and MLlib's
    ``checkpointInterval`` use it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server owns the folder)
        sc = None
    if not path and sc is not None:
        path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = sc.master if sc is not None else ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local_checkpoints()
    if sc is not None:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used before a frame is read many times by iterative work (model fits):
    a lost executor then re-reads the checkpoint instead of recomputing the
    whole join lineage.  Never a local checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the checkpoint folder.

    For rows that several jobs read: computed once, pruned to the columns
    that a job asks for, and safe from lost executors.  The table stays until
    the folder is cleared, as checkpoints do.  The shuffle files behind it go
    when it is written, so that they don't add up with the table.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    try:
        spark.conf.set(CLEAN_UP, "true")
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
