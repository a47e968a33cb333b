"""Row positions, row groups and order checks without a global window."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.errors import Invalid

POSITION, GROUP = "__pos", "__rg"


def with_position(df: DataFrame, start: int = 0, folder: str | None = None) -> DataFrame:
    """Dense row numbers in the order of partitions and of rows inside them.

    The frame is written once, each row with its partition and its place there, to
    ``folder`` (one below the checkpoint folder if none is named), which has to stay
    while the result is read.  Counts per partition (a number for each) and rows are
    both read from that copy: a second run of the frame may be dealt out otherwise.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/placed-{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", place)
    numbered.write.mode("overwrite").parquet(folder)
    copy = spark.read.schema(numbered.schema).parquet(folder)
    counts = sorted((r["__part"], r["n"]) for r in copy.groupBy("__part").agg(F.count("*").alias("n")).collect())
    offset, offsets = start, []
    for part, n in counts:
        offsets.append((part, offset))
        offset += n
    table = spark.createDataFrame(offsets, "__part int, __first long")
    return copy.join(F.broadcast(table), "__part").withColumn(POSITION, F.col("__first") + F.col("__at")).drop("__part", "__at", "__first")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.  A
    folder of this machine serves a local session only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise Invalid("writer.folder", "spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="placed-")


def with_group(df: DataFrame, rows: int, first_position: int = 0, first_group: int = 0) -> DataFrame:
    """Row group of each position; groups of ``rows`` rows counted from a start."""
    return df.withColumn(GROUP, (F.floor((F.col(POSITION) - first_position) / rows) + first_group).cast("long"))


def descends(previous: Sequence[Column], current: Sequence[Column]) -> Column:
    """Whether ``current`` comes before ``previous`` in lexicographic order."""
    out = current[-1] < previous[-1]
    for p, c in zip(reversed(previous[:-1]), reversed(current[:-1])):
        out = (c < p) | ((c == p) & out)
    return out


def violations_inside(df: DataFrame, keys: Sequence[str], group: str = GROUP, position: str = POSITION) -> DataFrame:
    """Rows of a group whose key comes before that of the row in front of them."""
    w = Window.partitionBy(group).orderBy(position)
    lagged = df.select(group, position, *keys, *[F.lag(k).over(w).alias(f"__prev_{i}") for i, k in enumerate(keys)])
    return lagged.filter(descends([F.col(f"__prev_{i}") for i in range(len(keys))], [F.col(k) for k in keys]))


def violations_between(bounds: DataFrame, first: Sequence[str], last: Sequence[str], group: str = GROUP) -> DataFrame:
    """Groups whose first key comes before the last key of the group in front."""
    before = bounds.select((F.col(group) + 1).alias(group), *[F.col(c).alias(f"__before_{i}") for i, c in enumerate(last)])
    return bounds.join(before, group).filter(descends([F.col(f"__before_{i}") for i in range(len(last))], [F.col(c) for c in first]))


def count_violations(df: DataFrame, keys: Sequence[str], group: str = GROUP, position: str = POSITION) -> DataFrame:
    """One row with the number of descents in the whole order."""
    # column by column: a struct in the aggregation's buffer would have all rows sorted
    ends = [(F.min_by(k, position).alias(f"__first_{i}"), F.max_by(k, position).alias(f"__last_{i}")) for i, k in enumerate(keys)]
    bounds = df.groupBy(group).agg(*[e for pair in ends for e in pair])
    n = len(keys)
    between = violations_between(bounds, [f"__first_{i}" for i in range(n)], [f"__last_{i}" for i in range(n)], group)
    both = violations_inside(df, keys, group, position).select(F.lit(1).alias("one")).unionAll(between.select(F.lit(1).alias("one")))
    return both.agg(F.count("*").alias("violations"))
