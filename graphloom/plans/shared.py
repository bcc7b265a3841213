"""Tables written to the folder that the cluster shares, to cut lineage and to read a costly result more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one if Spark runs on this machine alone.

    On a cluster executors would not share such a folder, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """`df` with `name`, its rows' numbers from 0 in the order of columns that tell them apart.

    Rows are range-sorted and written with their place in their range; the driver holds a count for each range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    ranges = written(ranges, "numbered")
    part = F.shiftright(name, 33)
    starts, n = [], 0
    for r in ranges.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], n))
        n += r["count"]
    firsts = df.sparkSession.createDataFrame(starts, "_part bigint, _first bigint")
    place = F.col(name).bitwiseAND((1 << 33) - 1) + F.col("_first")
    return ranges.withColumn("_part", part).join(F.broadcast(firsts), "_part").withColumn(name, place).drop("_part", "_first")


def distinct_rows(df: DataFrame, key: str, values: tuple[str, ...], sums: tuple[str, ...] = ()) -> DataFrame:
    """The distinct `values` with a new `key` (any number that tells them apart), `n_same` and `sums` of their rows; written.

    Equal values are found by a hash and then compared themselves.
    """
    return _distinct(df.withColumn("_hash", F.xxhash64(*values)), values, sums)[0].drop("_hash").withColumnRenamed("first", key)


def _distinct(rows: DataFrame, values: tuple[str, ...], sums: tuple[str, ...]) -> tuple[DataFrame, bool]:
    """The distinct rows with `_hash` and a number as `first`, and whether that is the hash, as it tells them apart."""
    found = rows.groupBy("_hash", *values).agg(F.count(F.lit(1)).alias("n_same"), *(F.sum(c).alias(c) for c in sums))
    found = written(found.withColumn("first", F.monotonically_increasing_id()), "distinct")
    apart = found.agg(F.count(F.lit(1)) == F.countDistinct("_hash")).first()[0]
    return (found.withColumn("first", F.col("_hash")) if apart else found), apart


def same_rows(df: DataFrame, key: str, values: tuple[str, ...], sums: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """What `distinct_rows` gives, and all rows with that key as `first`.

    The rows are written; they keep their own key, which may repeat, and go without `values`. Where no two distinct values
    share their hash, which is looked up, it is the key, so rows have theirs without a join.
    """
    rows = written(df.withColumn("_hash", F.xxhash64(*values)), "rows")
    distinct, apart = _distinct(rows, values, sums)
    if apart:
        members = rows.withColumnRenamed("_hash", "first").drop(*values)
    else:
        names = distinct.select(F.col("first"), *(F.col(c).alias(f"_as_{c}") for c in ("_hash", *values)))
        same = [F.col(c).eqNullSafe(F.col(f"_as_{c}")) for c in ("_hash", *values)]
        members = written(rows.join(names, same).select(*(c for c in rows.columns if c not in ("_hash", *values)), "first"), "members")
    return distinct.drop("_hash").withColumnRenamed("first", key), members


def for_members(members: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """`found`, rows of what `same_rows` found distinct, as rows of all that equal them."""
    return members.select(key, "first").join(found.withColumnRenamed(key, "first"), "first").drop("first")


def spread(df: DataFrame, key: str = "graph_id") -> DataFrame:
    """Rows over as many tasks as a shuffle has; of few and small files, or blocks that Spark joins, a task could get all."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def ranked(df: DataFrame, name: str, order: dict[str, Column]) -> DataFrame:
    """`df` with `name`, its rows' rank from 1 by what `order` names; rows that are equal in all of it share one.

    The rows are range-sorted, so no task ranks them alone; a rank is the least number of those that share it, plus one.
    """
    rows = df.withColumns({f"_{k}": c for k, c in order.items()})
    keys = [f"_{k}" for k in order]
    steps = numbered(rows.select(*keys).distinct(), "_step", *keys)
    sized = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(steps, keys), "ranks")
    part = F.shiftright("_step", 12)  # sums of a few thousand steps at a time, and over what comes before them
    within = F.sum("_n").over(Window.partitionBy("_part").orderBy("_step")) - F.col("_n")
    sums, before, total = sized.groupBy(part.alias("_part")).agg(F.sum("_n").alias("n")).orderBy("_part").toLocalIterator(), [], 0
    for r in sums:
        before.append((r["_part"], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    places = sized.withColumn("_part", part).withColumn("_within", within).join(F.broadcast(starts), "_part")
    places = places.select(*keys, (F.col("_before") + F.col("_within") + 1).cast("int").alias(name))
    return rows.join(places, keys).drop(*keys)
