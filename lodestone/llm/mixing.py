"""Mixing sources to target weights by systematic sampling.

A source's target in words gives the expected copies of each of its documents,
target / size of the source.  The documents of a source stand in a row by
size; along it the expected copies are summed, one offset in [0, 1) that
depends on the seed and the source is added, and a document is emitted once
for every integer that its own step crosses.  A source thus takes its target
up to about the words of its largest document, since neighbours in the row
are of like size; no document is emitted more often than its expected copies
rounded up, which is three times at most.

The prefix sums are distributed: documents are range-partitioned by (source,
size, doc_id), positions are counted within partitions, and only the number of
rows of each (source, partition) is summed along a source.  A source with a
third of all rows so spreads over a third of the partitions.

Defined results for odd input: null text has size 0, and size 0 takes 0 words
whatever its copies.  A null source is a source, last in order.  Repeated rows
count as so many documents.  If all sizes are 0, so are the targets.  An
empty table gives an empty result.  Extra columns are carried by `mix`, and
`copies` replaces a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, tidy, written

WEIGHTS = (1, 2, 3)
#: No document, and so no source, is taken more often than this.
MOST = 3
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from seed and source: 20 bits of a digest, which sums hold exactly."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("/"), source), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Sources in order of code points, null last, weigh WEIGHTS in turn and share
    the sum of all sizes; a target stops at MOST times its source's size, and
    the excess is shared by weight among the others.  With sources in order of
    limit / weight, those that stop are a first part of the row, so running
    sums find the level at which nothing is above.  The windows here run over
    sources, one row each, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumn("limit", F.lit(float(MOST)) * F.col("source_size"))
    everything = Window.partitionBy()
    row = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    per = per.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.col("left_size") / F.col("left_weight")
    free = F.when(level * F.col("weight") < F.col("limit"), level)
    # the first source in the row that does not stop sets the level for itself and all after it
    per = per.withColumn("level", F.first(free, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("limit")))
    return per.select("source", "source_size", target.alias("target"))


def copies(sized: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, source, size, ...) with source_size, target and copies, the number of times the mix emits each."""
    parts = max(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    others = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    placed = sized.repartitionByRange(parts, F.col("source").asc_nulls_last(), "size", "doc_id", *others)
    # written once: how the range is cut depends on a sample, and what follows reads it twice
    placed = written(placed.withColumn("part", F.spark_partition_id()))
    targets = source_targets(placed)
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("rows"))
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("rows").over(along), F.lit(0)))
    starts = starts.join(targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_", "rows")
    within = Window.partitionBy("source", "part").orderBy("size", "doc_id", *others)
    ranked = placed.withColumn("at", F.row_number().over(within))
    starts = starts.withColumnsRenamed({"source": "source_", "part": "part_"})
    joined = ranked.join(starts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("part") == F.col("part_")))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    reach = lambda n: F.floor(step * n.cast("double") + offset_of(F.col("source"), seed))
    position = F.col("start") + F.col("at")
    emitted = F.least(reach(position) - reach(position - 1), F.lit(MOST)).cast("long")  # at most MOST but for rounding
    return joined.withColumn("copies", emitted).select(*sized.columns, "source_size", "target", "copies")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size"))


@tidy
def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return copies(sizes(docs), seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is emitted, with its own columns.

    What is joined to the texts, which are shuffled once, is a number for each
    digest of a whole row.  Equal rows are interchangeable: their copies are
    pooled, each gets the same whole number of them, and what is left over is
    emitted once for each key, from any of its rows.  No window holds a key.
    """
    cols = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), "doc_id", "source", "text").withColumn("key", F.sha2(F.to_json("row"), 256))
    slim = keyed.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size"), "key")
    number = _numbers(slim, seed)
    each = keyed.join(number.where("each > 0").select("key", "each"), "key").select("row", "each")
    left = number.where("more > 0")
    if not left.isEmpty():
        some = keyed.join(left.select("key", "more"), "key").groupBy("key").agg(F.first("row").alias("row"), F.first("more").alias("each"))
        each = each.union(some.select("row", "each"))
    return each.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("each")))).select("row.*")


@tidy
def _numbers(slim: DataFrame, seed: str) -> DataFrame:
    """key, each, more: of the copies of all rows of a key what each of them gets, and the rest, which one of them gets."""
    number = copies(slim, seed).groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    return number.select("key", F.when(F.col("rows") == 1, F.col("copies")).otherwise(F.floor(F.col("copies") / F.col("rows"))).alias("each"), F.when(F.col("rows") > 1, F.col("copies") % F.col("rows")).otherwise(F.lit(0)).alias("more"))


ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS lim FROM per),
running AS (SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER w, 0) AS left_size, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM weighed WINDOW w AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, first_value(CASE WHEN left_size / left_weight * weight < lim THEN left_size / left_weight END IGNORE NULLS)
  OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM running),
targets AS (SELECT source, source_size, CASE WHEN level IS NULL THEN lim ELSE least(level * weight, lim) END AS target,
  CAST('0x' || substr(sha256('mix-1' || coalesce('/' || source, '')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS off FROM levels),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS n FROM sized)
SELECT p.doc_id, p.size, t.source_size, t.target,
  CAST(least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END * n + off) - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END * (n - 1) + off), 3) AS BIGINT) * p.size AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""
