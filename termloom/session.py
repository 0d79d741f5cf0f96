"""Session construction and the shared places that queries write to."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "termloom", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, adaptive execution, Arrow)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def parallelism(spark: SparkSession) -> int:
    """Tasks for a stage of Python work: a few for each core, never fewer than the shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * spark.sparkContext.defaultParallelism)


#: Bytes of a written table that one task of Python work takes.
TASK_BYTES = 32 << 20


def tasks_for(df: DataFrame) -> int:
    """Tasks for Python work on a written table: by its bytes, and as many as there are cores for at least."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(parallelism(df.sparkSession), -(-int(str(size)) // TASK_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset and
    the master is local, as in tests, a temporary folder is made and kept for the
    session; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("termloom.local.dir", "") or "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("termloom.local.dir", base)
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_dir(spark)}/termloom-{spark.sparkContext.applicationId}"


_to_clean: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to; what is written there goes when the driver's process ends."""
    if (app := spark.sparkContext.applicationId) not in _to_clean:
        _to_clean.add(app)
        atexit.register(_clean_at_end, spark)
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clean(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; results not yet read are gone."""
    drop_path(spark, own_dir(spark))


def _clean_at_end(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            clean(spark)
    except Exception:  # noqa: BLE001 - the session may have ended in any way
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table of ours."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python finds it."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="termloom-code-")) / "termloom"), "zip", package.parent, package.name)
    sc.addPyFile(archive)  # the driver serves it to every executor
    _shipped.add(sc.applicationId)
