"""Session factory, table access and lineage cuts through the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "kinloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; cluster defaults stay untouched unless named."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    return builder.config(map=settings).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers, once an application; the driver serves the archive to them."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        home = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{home.name}", "zip", home.parent, home.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a Parquet file or a folder of them."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster sets it.

    Only where it is unset (a local test session) a folder of this machine is taken, and kept for the session.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="kinloom-shared-")
        spark.conf.set(CHECKPOINT_CONF, found)
    return found


_ROOTS: dict[str, list[str]] = {}


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this application; to be called once its results are written elsewhere."""
    for root in _ROOTS.pop(spark.sparkContext.applicationId, []):
        _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to the shared folder to cut lineage: they outlive lost executors, and are dropped by path, those of
    results by drop_scratch."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._scratch_path)


def is_empty(df: DataFrame) -> bool:
    return not df.select(F.lit(1)).take(1)
