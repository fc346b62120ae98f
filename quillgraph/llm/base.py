"""What the operators share: written tables in the cluster's shared folder, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only where a session names no shared folder, as in tests on one machine.
LOCAL_SHARED = "/tmp/checkpoints"

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; set here only where it is unset and all runs on one machine."""
    got = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = f"file://{LOCAL_SHARED}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/quillgraph-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: this cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a saved() table that no later plan reads."""
    path = df.scratch_path
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is never copied into its uses by the optimizer."""
    return F.transform(F.array(value), body)[0]


def whole(id: str) -> Column:
    """An id column as text, for Python: pandas makes doubles of longs beside a null, which are not exact over 2 ** 53."""
    return F.col(f"`{id}`").cast("long").cast("string")


def with_long(df: DataFrame, name: str = "id") -> DataFrame:
    """Turns whole() back, in place."""
    return df.withColumn(name, F.col(name).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_level(total: int, most: int = 10_000, least: int = 250) -> int:
    """Keys with more rows than this are hot: fewer than `most` of a table of `total` rows, so that a list of them may be broadcast."""
    return max(least, -(-total // most))


def _parts(n: str, level: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(n), F.lit(1)) / level)).cast("int")


def dealt(df: DataFrame, n: str, level: int, by: str) -> DataFrame:
    """Adds `salt`: rows of a key that has n of them (null: few) are dealt by the hash of `by` to parts of about level rows."""
    return df.withColumn("salt", F.pmod(F.xxhash64(by), _parts(n, level)).cast("int"))


def copied(df: DataFrame, n: str, level: int) -> DataFrame:
    """Adds `salt`: the one row of a key is copied to all parts that dealt() makes of the key."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), _parts(n, level) - 1)))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `rank`, from 0, in a total order of all rows, without one task that sees them all."""
    from pyspark.sql import Window

    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    dealt = saved(dealt, name)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(before, "_part").withColumn("rank", F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 2048, few: int = 5000) -> float | None:
    """The k-th largest non-null value of a double column: counts in ever finer bins, so the driver gets `bins` counts at a time."""
    col = F.col(column)
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while low < high:
        step = (high - low) / bins
        if n <= few or step == 0 or low + step == low:
            inside = df.where((col >= low) & (col <= high)).groupBy(col.alias("v")).count().orderBy(F.desc("v"))
            for v, c in inside.toLocalIterator():
                k -= c
                if k <= 0:
                    return v
        place = F.least(F.floor((col - low) / step), F.lit(bins - 1))
        counts = dict(df.where((col >= low) & (col <= high)).groupBy(place.alias("b")).agg(F.struct(F.count("*"), F.min(col), F.max(col))).collect())
        for b in sorted(counts, reverse=True):
            c, lo, hi = counts[b]
            if k <= c:
                low, high, n = lo, hi, c
                break
            k -= c
    return low
