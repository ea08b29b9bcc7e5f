"""What the training-data operators share: reading tables, written tables, safe column references."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that working columns cannot clash with them."""
    return F.struct(*[col(c) for c in df.columns])


def keyed(df: DataFrame, id_col: str) -> DataFrame:
    """(key, row): each row as a struct with its id, or where that is null a number of its own above all ids, written down so that it holds."""
    rows = df.select(col(id_col).cast("long").alias("key"), packed(df).alias("row"))
    lost = rows.filter("key is null")
    if not lost.limit(1).count():
        return rows
    most = rows.agg(F.coalesce(F.max("key"), F.lit(0)).alias("most")).first()["most"]
    named = written(lost.select((F.monotonically_increasing_id() + max(most, 0) + 1).alias("key"), "row"), "rows-without-id")
    return rows.filter("key is not null").unionByName(named)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where none is set and all run on one machine."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pitframe-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")  # the table holds the rows now, so the shuffles that made it need not stay on disk
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (a shuffle join then)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def grows(df: DataFrame) -> DataFrame:
    """``df`` marked as a side that grows with the corpus: it is not broadcast even while it is small, so plans are the same at every size."""
    return df.hint("merge")


def ship(module: str) -> None:
    """Executors get the functions of this module with the query, so that nothing has to be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
