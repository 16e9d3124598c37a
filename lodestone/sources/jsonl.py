"""JSON lines, strict and tolerant, and their sinks."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

CORRUPT = "_corrupt_record"


def schema_of(ddl: str) -> StructType:
    found = _parse_datatype_string(ddl)
    assert isinstance(found, StructType)
    return found


def read_strict(spark: SparkSession, path: str, ddl: str, derived: Iterable[str] = (), forbid_extra: bool = True) -> DataFrame:
    """Every row must parse, and, if so asked, hold no field but those of the schema and `derived`.

    The reader itself skips unknown fields, so their names are checked on the
    text, in the same pass as the parse.  Blank lines are skipped.
    """
    schema = schema_of(ddl)
    if not forbid_extra:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    allowed = F.array(*[F.lit(c) for c in [*schema.names, *derived]])
    lines = spark.read.text(path).where(F.trim("value") != "")
    extra = F.array_except(F.coalesce(F.json_object_keys("value"), F.array(F.lit("(no object)"))), allowed)
    checked = F.when(F.size(extra) == 0, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("unexpected fields: "), F.array_join(extra, ", "))))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_tolerant(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the rows that did not parse."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    schema = StructType([*schema_of(ddl).fields]).add(CORRUPT, "string")
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_optional(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """An absent log is an empty one; bad JSON is fatal; lines that hold no object are skipped; extra fields are allowed."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema_of(ddl))
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    return lines.select(F.from_json("value", schema_of(ddl), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def load_questions(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A question file, a list or an object with `questions`: a hand-written file of tens of rows."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    rows = raw.get("questions", []) if isinstance(raw, dict) else raw
    schema = schema_of(ddl)
    text = lambda v: None if v is None else [str(x) for x in v] if isinstance(v, list) else str(v)
    return spark.createDataFrame([tuple(text(r.get(c)) for c in schema.names) for r in rows], schema)
