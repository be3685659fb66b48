"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Only where neither is set and the session is local (tests) is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kilnworks-"))
    return jsc.getCheckpointDir().get().rstrip("/")


#: Folders made by scratch_path() that are still there.
_FOLDERS: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is left there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/kilnworks-{name}-{uuid.uuid4().hex}"
    _FOLDERS[path] = spark
    return path


def remove_path(path: str) -> None:
    """Remove a folder of scratch_path(), through the file system it lies in."""
    spark = _FOLDERS.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._kilnworks_path = path
    return found


def release(*frames: DataFrame | None) -> None:
    """Remove what materialize() wrote for these frames; nothing may read them any more."""
    for df in frames:
        path = getattr(df, "_kilnworks_path", None)
        if path:
            remove_path(path)


@atexit.register
def _sweep() -> None:
    for path in list(_FOLDERS):
        try:
            remove_path(path)
        except Exception:  # the session may have ended before
            return


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has at most that many rows; else the other side is shuffled to it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: How many keys count as hot, and how many rows such a key has at least: no other key has more than one in HOT_KEYS of all rows.
HOT_KEYS, HOT_ROWS = 1000, 1000


def hottest(counted: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """The keys of `counted` with the most rows, HOT_KEYS at most."""
    return counted.filter(F.col(count) >= HOT_ROWS).orderBy(F.col(count).desc(), *keys).limit(HOT_KEYS).select(*keys)


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], by: str, hot: DataFrame, how: str = "inner", salts: int = 64) -> DataFrame:
    """left joined with right on keys, where the left rows of the keys in `hot` (hottest()) are dealt into parts by the hash of column `by`.

    The right rows of those keys are repeated for each part, so no task gets all rows of a hot key. Each side is read
    once. how: inner or left.
    """
    marked = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))  # HOT_KEYS rows
    dealt = left.join(marked, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = right.join(marked, keys, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, *LOWER_AZ)
