"""Session, tables and checkpoints."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "textmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, which may not find it where the driver does; once a session."""
    sc = spark.sparkContext
    if any(Path(p).name.startswith("textmill-package-") for p in sc._python_includes):
        return
    package = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="textmill-package-", suffix=".zip", delete=False) as out:
        with zipfile.ZipFile(out, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, Path(package.name) / file.relative_to(package))
    sc.addPyFile(out.name)  # the driver's own copy, which Spark hands out
    atexit.register(Path(out.name).unlink, missing_ok=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame, least: int = 2 << 20, group: int = 128 << 20) -> DataFrame:
    """Rows over all cores, where a table of ``least`` bytes or more lies in fewer files than there are cores.

    A row group is read by one task, however many splits its file is cut into, and files of up to ``group`` bytes
    are mostly one row group. Tables of many or of larger files are left as they are:
    nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if size < least or size > group * cores:
        return df
    files = len(df.inputFiles())
    return df if files >= cores or size > group * files else df.repartition(cores)


def stored(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], load, make):
    """What was made of some tables: made and stored once, then loaded, as long as the files of the tables are the same.

    ``load`` gets a path in the shared folder and fails with an ``AnalysisException`` if nothing is there; ``make`` gets
    it, stores there and returns what it made.
    """
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in tables]).select("path", "length", "modificationTime")
    state = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0]
    path = f"{shared_folder(spark)}/{name}-{state}"
    try:
        return load(path)
    except AnalysisException:  # not stored yet
        return make(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests, a laptop) a temporary
    folder is made, once a session; a cluster without it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """The tables of a run of rounds in the shared folder: each is written, read by the next round, and deleted when there are two newer ones."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.folder, self.count = f"{shared_folder(self.spark)}/rounds-{uuid.uuid4().hex}", 0

    def store(self, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        rows.write.parquet(path)
        self._delete(f"{self.folder}/{self.count - 2}")
        self.count += 1
        return self.spark.read.schema(rows.schema).parquet(path)

    def close(self) -> None:
        """Delete all tables, when nothing reads them any more."""
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
