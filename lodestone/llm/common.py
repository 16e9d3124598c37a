"""What several operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A word, in Java's and in DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster's spark.checkpoint.dir; a folder of our own in the warehouse only where none is set, as in tests."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_ is None:
        set_ = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodestone"
        spark.sparkContext.setCheckpointDir(set_)
    return set_


def released(run):
    """A function for mapInArrow that, when it has ended, gives the memory its worker has freed back to the machine: idle workers stay for a while."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
            if trim:
                trim(0)

    return wrapped


#: Rows, and bytes, that go to a Python worker at a time when something is written: rows here hold texts or sets.
BATCH, BATCH_BYTES = 2000, 8 << 20
#: Shuffle files go when the query that wrote them ends; else they stay until the driver happens to collect garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each `tidy` function that runs, what `written` wrote in it.
_RUNNING: list[list[DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-{uuid.uuid4().hex}"
    least = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in (*least, FREED)}
    for k, v in least.items():
        spark.conf.set(k, str(min(int(before[k]), v) if (before[k] or "").isdigit() and int(before[k]) > 0 else v))
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    if _RUNNING:
        _RUNNING[-1].append(out)
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what `written` wrote, once nothing reads it any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
        df._lodestone_path = None


def tidy(f):
    """The result of `f` is written, and then all that was written on the way is deleted, also if `f` fails."""

    @functools.wraps(f)
    def run(*args, **named):
        _RUNNING.append([])
        try:
            out = f(*args, **named)
            inner, own = _RUNNING[-1], []
            _RUNNING[-1] = own
            out = written(out)
            _RUNNING[-1] = inner
        finally:
            for df in _RUNNING.pop():
                discard(df)
        if _RUNNING:
            _RUNNING[-1].append(out)
        return out

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected `edges` (a, b): rows (id, component), the smallest id of each.

    Alternates the large-star and small-star steps, which end in one star per
    component after a number of rounds that grows with the logarithm of the
    longest path.  Both steps are a minimum per key, combined before the
    shuffle, and a join back; no neighbourhood is ever gathered, so a hub with
    very many neighbours is a skewed join that adaptive execution splits.
    Nodes without an edge to another node do not occur in the result.
    """
    edges, state = _counted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u move to the smallest of u's neighbourhood
        stars, moved = _counted(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        if moved == state:  # nothing has moved
            discard(stars)
            low = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
            if low.isEmpty():  # and all have one neighbour below: stars
                break
            stars = edges
        # small star: u and its smaller neighbours move to the smallest of these
        low = stars.groupBy("u").agg(F.min("v").alias("m"))
        closer = stars.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, (edges, state) = edges, _counted(closer.union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        discard(stars)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """`edges` written, and their number and checksum, taken as they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
    return out, (seen.get["n"], seen.get["s"])


class Rows:
    """Rows in an order within groups, dealt out so that a large group spreads over many tasks.

    Range-partitions by group and order, writes the result once (how the range
    is cut depends on a sample), and numbers partitions.  `running` then sums
    within (group, partition) and adds what earlier partitions of the group
    hold; only one row for each (group, partition) is ever put in a row.
    """

    def __init__(self, df: DataFrame, group: list[str], order: list[str]):
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
        self.group, self.order = group, order
        self.rows = written(df.repartitionByRange(parts, *group, *order).withColumn("part", F.spark_partition_id()))

    def running(self, rows: DataFrame, **sums) -> DataFrame:
        """`rows` (those of self.rows, perhaps with more columns) with the inclusive running sum of each given column expression."""
        rows = rows.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in sums.items()})
        key = [*self.group, "part"]
        along = Window.partitionBy(*self.group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy(*key).agg(*[F.sum(k).alias(k) for k in sums])
        starts = starts.select(*[F.col(c).alias(f"{c}_") for c in key], *[F.coalesce(F.sum(k).over(along), F.lit(0)).alias(f"{k}_") for k in sums])
        within = Window.partitionBy(*key).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({k: F.sum(k).over(within) for k in sums})
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in self.group] + [F.col("part") == F.col("part_")]
        on = same[0]
        for x in same[1:]:
            on = on & x
        joined = rows.join(starts, on).withColumns({k: F.col(k) + F.col(f"{k}_") for k in sums})
        return joined.drop(*[f"{c}_" for c in key], *[f"{k}_" for k in sums])
