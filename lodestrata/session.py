"""Session helpers: tables, shared storage for cut lineage, clash-free names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "lodestrata", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, else the checkpoint folder of the Spark context.

    Only a local master may go without: all tasks then run on this machine, whose folder for temporary files serves. On
    a cluster a missing setting raises, since what executors write to their own disks can't be read back.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return "file://" + os.path.join(tempfile.gettempdir(), "lodestrata-shared")


class Workspace:
    """Written tables of one operator run; they cut lineage and outlive lost executors.

    A table that a later one replaces is dropped at once (`drop`, `keep`), so the space held stays in proportion to the
    input. What the returned plan still reads stays until `close`, or until the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.n = 0
        self.held: set[str] = set()
        fs, p = self._at(self.root)
        fs.deleteOnExit(p)

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """Write df and read it back. files: at most so many output files, without a shuffle."""
        path = f"{self.root}/{self.n:05d}"
        self.n += 1
        schema = df.schema
        (df if files is None else df.coalesce(files)).write.parquet(path)
        self.held.add(path)
        back = self.spark.read.schema(schema).parquet(path)
        back._lodestrata_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_lodestrata_path", None)
        if path in self.held:
            fs, p = self._at(path)
            fs.delete(p, True)
            self.held.discard(path)

    def keep(self, *tables: DataFrame) -> None:
        """Drops all tables but these."""
        wanted = {getattr(t, "_lodestrata_path", None) for t in tables}
        for path in sorted(self.held - wanted):
            fs, p = self._at(path)
            fs.delete(p, True)
            self.held.discard(path)

    def close(self) -> None:
        """Drops everything, once no plan reads it any more."""
        fs, p = self._at(self.root)
        fs.delete(p, True)
        self.held.clear()


def with_defaults(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select exactly these columns (name -> type); an absent one becomes NULL, extra ones are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
