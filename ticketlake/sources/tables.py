"""Table sinks, build-if-missing, JSON reports and run logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from ticketlake.functions.coerce import finite_or_null

RUN_SCHEMA = (
    "run_id string, id string, `when` string, component string, status string, params map<string,string>, "
    "metrics map<string,string>, artifacts map<string,string>, _corrupt_record string"
)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table to read: no if the path is absent or holds no files. Any other trouble, as a lack of permission
    or files that are no table, is an error and not a missing table, so nothing is built over what is there."""
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            if files.select("path").limit(1).isEmpty():
                return False
        raise


def ensure_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a derived table, building it first when it is missing."""
    if not table_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
        if not table_exists(spark, path):
            raise FileNotFoundError(f"the build did not produce {path}")
    return spark.read.parquet(path)


def ensure_tables(spark: SparkSession, root: str, build: Callable[[], dict[str, DataFrame]], names: list[str]) -> dict[str, DataFrame]:
    """Read a family of derived tables; one missing member rebuilds them all."""
    if not all(table_exists(spark, f"{root}/{n}") for n in names):
        write_tables(build(), root)
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_splits(df: DataFrame, path: str, layout: str = "parquet") -> None:
    """One table partitioned by split, so that a reader of one split opens only its files."""
    df.write.mode("overwrite").partitionBy("split").format(layout).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_ready(df: DataFrame) -> DataFrame:
    """Dates and times as YYYY-MM-DD text, non-finite numbers as null."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.date_format(F.col(f.name), "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = finite_or_null(f.name)
    return df.withColumns(out) if out else df


def write_json_report(df: DataFrame, path: str) -> None:
    """JSON lines, every field present, nulls written out."""
    json_ready(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_run(record: DataFrame, path: str) -> None:
    """Add runs to a log. What is appended together is a folder named after its runs, which a retried job writes again."""
    named = F.coalesce(*(F.col(c) for c in ("run_id", "id") if c in record.columns), F.lit(""))
    number = record.agg(F.coalesce(F.bit_xor(F.xxhash64(named)), F.lit(0)).alias("x")).first()["x"]
    record.write.mode("overwrite").json(f"{path}/append={number & (1 << 64) - 1:016x}")


def read_run_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, malformed lines). Blank lines are ignored; a malformed line does not spoil its neighbours, and a run that was
    logged twice in the same words is one."""
    text = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "")
    parsed = text.select(
        "value",
        F.from_json("value", RUN_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"),
    )
    runs = parsed.where("r._corrupt_record IS NULL").dropDuplicates(["value"]).select("r.*").drop("_corrupt_record")
    return runs, parsed.where("r._corrupt_record IS NOT NULL").select("value")
