"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings that a running session can take. A hot join key is split even where that costs one more shuffle; session
# streams merge the sessions of a hot key in each task before the shuffle; JSON text may repeat a key.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
SETTINGS = {**SQL_SETTINGS, "spark.ui.enabled": "false"}


def apply_settings(spark: SparkSession) -> None:
    """Bring a session that was made elsewhere to the settings above, and the package to its executors."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to all executors once per application, for those that have no installed copy of it."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="fretwork-"), f"fretwork-{application}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for place, _, names in os.walk(folder):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(place, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(folder)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


_shipped: set[str] = set()


def build_session(
    app: str,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings that the jobs rely on.

    ``master`` and ``shuffle_partitions`` stay with the cluster's own configuration unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (a laptop, the tests) does a local folder take its place.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fretwork-")
        spark.conf.set(CHECKPOINT_KEY, root)
    base = _scopes[-1] if _scopes else f"{root.rstrip('/')}/fretwork"
    return f"{base}/{name}-{uuid.uuid4().hex}"


_scopes: list[str] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables that are written inside stand in one folder, which is removed at the end.

    Read or write the results inside: they may depend on those tables.
    """
    base = scratch_dir(spark, "scope")
    _scopes.append(base)
    try:
        yield base
    finally:
        _scopes.remove(base)
        remove_folder(spark, base)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def conf_scope(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside only."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_together(*jobs: Callable[[], object], at_once: int | None = None) -> list:
    """Run independent jobs at the same time, each as Spark jobs of its own; their results in order, or the first error after all ended."""
    with ThreadPoolExecutor(max(1, at_once or len(jobs))) as pool:
        return [future.result() for future in [pool.submit(job) for job in jobs]]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back as a columnar table.

    For plans that read an expensive input several times: the written table survives lost executors,
    keeps column pruning, and carries real sizes for the join choice.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
