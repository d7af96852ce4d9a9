"""The ticket record: field types, column groups and completion policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The record layout that every ticket source must follow.
_FIELDS = {
    T.StringType(): [
        "ticket_id", "customer_id", "customer_tier", "organization_id", "product", "product_version",
        "product_module", "category", "subcategory", "priority", "severity", "channel", "subject",
        "description", "error_logs", "stack_trace", "customer_sentiment", "resolution", "resolution_code",
        "agent_id", "agent_specialization", "escalation_reason", "feedback_text", "environment",
        "resolution_template_used", "business_impact", "language", "region",
    ],
    T.TimestampType(): ["created_at", "updated_at", "resolved_at"],
    T.IntegerType(): [
        "previous_tickets", "resolution_attempts", "agent_experience_months", "transferred_count",
        "satisfaction_score", "account_age_days", "similar_issues_last_30_days", "product_version_age_days",
        "ticket_text_length", "response_count", "attachments_count", "affected_users",
    ],
    T.DoubleType(): ["resolution_time_hours", "account_monthly_value"],
    T.BooleanType(): [
        "escalated", "resolution_helpful", "known_issue", "bug_report_filed", "auto_suggestion_accepted",
        "contains_error_code", "contains_stack_trace", "weekend_ticket", "after_hours",
    ],
    T.ArrayType(T.StringType()): [
        "agent_actions", "tags", "related_tickets", "kb_articles_viewed", "kb_articles_helpful",
        "auto_suggested_solutions",
    ],
}

# Fields that may not be null, and the bounds of the two bounded fields.
REQUIRED = ["ticket_id", "created_at", "subject", "description"]
BOUNDS = {"previous_tickets": (0, None), "satisfaction_score": (1, 5)}

# Feature column groups. The flags are completed and coerced but are not model features.
TEXT_COLUMNS = ["subject", "description", "error_logs", "stack_trace"]
CATEGORICAL_COLUMNS = [
    "product", "product_module", "language", "region", "priority", "severity", "customer_tier", "channel",
    "environment",
]
FLAG_COLUMNS = [
    "contains_error_code", "contains_stack_trace", "weekend_ticket", "after_hours", "known_issue",
    "bug_report_filed", "auto_suggestion_accepted", "resolution_helpful", "escalated",
]
NUMERIC_COLUMNS = [
    "previous_tickets", "account_age_days", "account_monthly_value", "similar_issues_last_30_days",
    "product_version_age_days", "ticket_text_length", "response_count", "attachments_count",
    "affected_users", "resolution_time_hours", "resolution_attempts", "agent_experience_months",
    "transferred_count", "satisfaction_score",
]
TARGET_COLUMNS = ["category", "subcategory"]

# Columns a split must carry to be usable.
SPLIT_REQUIRED = ["ticket_id", "created_at", "subject", "description", "category"]

FIELD_TYPES: dict[str, T.DataType] = {name: dtype for dtype, names in _FIELDS.items() for name in names}


def ticket_schema() -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in FIELD_TYPES.items()])


def raw_types() -> dict[str, T.DataType]:
    """Types before conversion: scalars stay strings so that one bad value cannot spoil its record."""
    return {name: dtype if isinstance(dtype, T.ArrayType) else T.StringType() for name, dtype in FIELD_TYPES.items()}


def delivered_schema(rejected: str) -> T.StructType:
    """Reader schema: every field as it was delivered, and the text of what is no record."""
    fields = [T.StructField(name, T.VariantType(), True) for name in FIELD_TYPES]
    return T.StructType([*fields, T.StructField(rejected, T.StringType(), True)])


def _feature_columns() -> list[str]:
    return TEXT_COLUMNS + CATEGORICAL_COLUMNS + FLAG_COLUMNS + NUMERIC_COLUMNS + TARGET_COLUMNS


def complete_nullable(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add absent columns: flags as false, anything else as a typed null."""
    missing = [c for c in (columns or _feature_columns()) if c not in df.columns]
    return df.withColumns({c: _null_default(c) for c in missing}) if missing else df


def _null_default(name: str) -> Column:
    if name in FLAG_COLUMNS:
        return F.lit(False)
    return F.lit(None).cast(FIELD_TYPES.get(name, T.StringType()))


def complete_typed(df: DataFrame) -> DataFrame:
    """Add absent columns and fill nulls: text '', categorical 'unknown', flag false, number 0, target 'Unknown'."""
    defaults: dict[str, Column] = {}
    defaults |= {c: F.lit("") for c in TEXT_COLUMNS}
    defaults |= {c: F.lit("unknown") for c in CATEGORICAL_COLUMNS}
    defaults |= {c: F.lit(False) for c in FLAG_COLUMNS}
    defaults |= {c: F.lit(0.0) for c in NUMERIC_COLUMNS}
    defaults |= {"category": F.lit("Unknown")}

    def filled(name: str, default: Column) -> Column:
        if name not in df.columns:
            return default
        value = F.col(name)
        if name in FLAG_COLUMNS:
            value = value.try_cast("boolean")
        elif name in NUMERIC_COLUMNS:
            value = value.try_cast("double")
        return F.coalesce(value, default)

    return df.withColumns({name: filled(name, default) for name, default in defaults.items()})
