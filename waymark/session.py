"""Session helpers: a local session for tests, and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, in UTC, for tests and benchmarks."""
    conf = {
        "spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("waymark").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package, where their PYTHONPATH doesn't have it already."""
    sc = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if sc.applicationId in _shipped or str(_PACKAGE.parent) in paths:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="waymark-code-"), "waymark_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where it is unset and Spark is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the shared folder, without its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has run."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Scratch:
    """Parquet tables in the shared folder. They cut lineage and survive lost executors.

    Tables go when ``drop`` names them, or else when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._root = f"{shared_dir(spark)}/waymark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths[name])
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def place(self, name: str) -> str:
        """A path that goes as the tables do."""
        self._paths[name] = f"{self._root}/{name}"
        path, fs = self._path(name)
        fs.deleteOnExit(path)
        return self._paths[name]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table. The shuffle files that it took go at once."""
        path = self.place(name)
        with shuffles_cleared(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(self._paths[name])

    def save_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """As ``save``, with the number of rows, counted while they are written."""
        counted = Observation()
        out = self.save(df.observe(counted, F.count(F.lit(1)).alias("rows")), name)
        return out, counted.get["rows"]

    def together(self, names: list[str], schema) -> DataFrame:
        """Tables of the same columns as one; its plan is the same however many there are."""
        return self.spark.read.schema(schema).parquet(*[self._paths[name] for name in names])

    def drop(self, *names: str) -> None:
        """Delete tables that no result still reads."""
        for name in names:
            path, fs = self._path(name)
            fs.delete(path, True)
            del self._paths[name]

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*[name for name in self._paths if name not in names])
