"""Record validation, data-quality checks and split profiles. Every check is one scan with partial aggregation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ticketlake.functions.coerce import wall_clock
from ticketlake.schema import BOUNDS, FIELD_TYPES, REQUIRED, SPLIT_REQUIRED


# Column of raw records: names of the text and list fields that hold another kind of value.
WRONG_KIND = "_wrong_kind"


class QualityError(RuntimeError):
    """A record set did not pass its quality gate."""


def _typed(name: str, dtype: T.DataType) -> Column:
    return F.col(name) if isinstance(dtype, T.ArrayType) else F.col(name).try_cast(dtype)


def typed(raw: DataFrame) -> DataFrame:
    """Raw string records as typed records; values that do not parse become null.

    ``created_wall`` is the creation time as written, without its zone: the day a ticket counts for.
    """
    wall = wall_clock("created_at") if "created_at" in raw.columns else F.lit(None).cast("timestamp_ntz")
    return raw.select(*[
        _typed(f, t).alias(f) if f in raw.columns else F.lit(None).cast(t).alias(f)
        for f, t in FIELD_TYPES.items()
    ], wall.alias("created_wall"))


def wrong_kinds(types: dict[str, T.DataType]) -> Column:
    """Names of the text and list fields, given as variants, that hold another kind of value. Nulls are no fault."""
    def wrong(name: str, dtype: T.DataType) -> Column:
        kind = F.schema_of_variant(name)
        if isinstance(dtype, T.ArrayType):
            return ~kind.isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>")
        return ~kind.isin("VOID", "STRING")

    tests = [(n, wrong(n, t)) for n, t in types.items() if isinstance(t, (T.StringType, T.ArrayType))]
    return F.array_compact(F.array(*[F.when(broken, F.lit(n)) for n, broken in tests]))


def violations(
    raw: DataFrame,
    id_col: str = "ticket_id",
    types: dict[str, T.DataType] | None = None,
    required: Iterable[str] = REQUIRED,
    bounds: dict[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """One row per broken rule: (id, field, rule) with rule in required, type, min, max.

    Map-only: each record is tested in place and only its failures are emitted. Text and list fields can only be told
    from other kinds before they are read as strings: records of ``read_raw`` bring the result of that test.
    """
    types = FIELD_TYPES if types is None else types
    bounds = BOUNDS if bounds is None else bounds
    tests: list[tuple[str, str, Column]] = []
    for name in required:
        tests.append((name, "required", F.col(name).isNull() if name in raw.columns else F.lit(True)))
    for name, dtype in types.items():
        if name not in raw.columns:
            continue
        if isinstance(dtype, (T.StringType, T.ArrayType)):
            if WRONG_KIND in raw.columns:
                tests.append((name, "type", F.array_contains(WRONG_KIND, name)))
            continue
        value = F.col(name).try_cast(dtype)
        tests.append((name, "type", F.col(name).isNotNull() & value.isNull()))
        low, high = bounds.get(name, (None, None))
        if low is not None:
            tests.append((name, "min", value < low))
        if high is not None:
            tests.append((name, "max", value > high))
    found = F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(rule).alias("rule")))
        for f, rule, broken in tests
    ])
    return raw.select(F.col(id_col), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select(
        id_col, "v.field", "v.rule"
    )


def validate_or_raise(raw: DataFrame, **options) -> None:
    """Stop at the first broken record."""
    first = violations(raw, **options).limit(1).collect()
    if first:
        raise QualityError(f"invalid record: {first[0].asDict()}")


def _check_measures(
    df: DataFrame,
    non_null: Iterable[str],
    time_order: Iterable[tuple[str, str]],
    ranges: Iterable[tuple[str, float, float, str]],
) -> list[tuple[str, Column]]:
    present = set(df.columns)
    measures: list[tuple[str, Column]] = []
    for c in non_null:
        bad = F.count_if(F.col(c).isNull()) if c in present else F.lit(None).cast("bigint")
        measures.append((f"non_null:{c}", bad))
    for a, b in time_order:
        if {a, b} <= present:
            measures.append((f"time_order:{a}<={b}", F.count_if(F.col(a) > F.col(b))))
    for c, low, high, label in ranges:
        if c in present:
            measures.append((label, F.count_if((F.col(c) < low) | (F.col(c) > high))))
    return measures


# The checks a ticket table must pass.
TICKET_CHECKS = {
    "non_null": ["subject", "description", "created_at", "ticket_id"],
    "time_order": [("created_at", "updated_at"), ("created_at", "resolved_at")],
    "ranges": [("satisfaction_score", 1, 5, "range:satisfaction_score_1_to_5")],
}


def _measured_checks(df: DataFrame, non_null, time_order, ranges) -> DataFrame:
    """One row: the row count and the array of (check, bad_rows), all from a single scan."""
    measures = _check_measures(
        df,
        TICKET_CHECKS["non_null"] if non_null is None else non_null,
        TICKET_CHECKS["time_order"] if time_order is None else time_order,
        TICKET_CHECKS["ranges"] if ranges is None else ranges,
    )
    measured = df.agg(F.count(F.lit(1)).alias("row_count"), *[m.alias(f"m{i}") for i, (_, m) in enumerate(measures)])
    bad = [(name, F.col(f"m{i}")) for i, (name, _) in enumerate(measures)]
    checks = F.array(*[
        F.struct(
            F.lit(name).alias("check"), n.alias("bad_rows"), F.coalesce(n == 0, F.lit(False)).alias("passed"),
            F.when(n.isNull(), "missing_column").alias("error"),
        )
        for name, n in bad
    ])
    return measured.select("row_count", checks.alias("checks"))


def dq_checks(df: DataFrame, non_null=None, time_order=None, ranges=None) -> DataFrame:
    """One row per check: (check, bad_rows, passed, error). A required column that is absent fails."""
    return _measured_checks(df, non_null, time_order, ranges).select(F.inline("checks"))


def dq_report(df: DataFrame, non_null=None, time_order=None, ranges=None) -> DataFrame:
    """One row: overall success, row count and the list of checks."""
    measured = _measured_checks(df, non_null, time_order, ranges)
    return measured.select(F.forall("checks", lambda c: c["passed"]).alias("success"), "row_count", "checks")


REPORT = "success boolean, row_count bigint, checks array<struct<check:string,bad_rows:bigint,passed:boolean,error:string>>"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def quality_gate(report: DataFrame, sink_path: str | None = None) -> None:
    """Write the one-row report, then fail when it is not successful."""
    if sink_path:
        report.write.mode("overwrite").json(sink_path)
    if not report.first()["success"]:
        raise QualityError("data-quality checks failed")


def split_profile(df: DataFrame, split_col: str = "split", required: Iterable[str] = SPLIT_REQUIRED) -> DataFrame:
    """Long profile (split, metric, name, value): sizes, missing required columns, columns that have nulls."""
    columns = [c for c in df.columns if c != split_col]
    measured = df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(columns)],
    )

    def row(metric: str, name: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.lit(name).alias("name"), value.alias("value"))

    rows = [row("n_rows", "", F.col("n_rows")), row("n_cols", "", F.lit(len(columns)).cast("bigint"))]
    rows += [row("missing_column", c, F.lit(1).cast("bigint")) for c in required if c not in columns]
    rows += [row("null_count", c, F.col(f"null_{i}")) for i, c in enumerate(columns)]
    return measured.select(split_col, F.inline(F.array(*rows))).where("metric <> 'null_count' OR value > 0")


def category_frequency(df: DataFrame, split_col: str = "split", category: str = "category") -> DataFrame:
    """Category counts per split; null categories are not counted."""
    return df.where(F.col(category).isNotNull()).groupBy(split_col, category).agg(F.count(F.lit(1)).alias("n"))
