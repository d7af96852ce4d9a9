"""Ticket readers: JSON array or JSON lines in, typed tickets out; splits; single-ticket picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ticketlake.functions.coerce import seeded_hash
from ticketlake.functions.text import strip
from ticketlake.operators.quality import WRONG_KIND, QualityError, typed, wrong_kinds
from ticketlake.schema import FIELD_TYPES, delivered_schema, raw_types
from ticketlake.sources.arrays import array_records


REJECTED, FILE = "_corrupt_record", "_file"


def read_records(spark: SparkSession, path: str, layout: str = "lines", encoding: str = "UTF-8") -> DataFrame:
    """Records as delivered: a variant for each field, and the text of what is no JSON record in ``_corrupt_record``.

    ``layout`` is 'lines' or 'array'; both are read by ranges of a file, and a broken record spoils itself only (see
    ``array_records``). An array in another encoding than UTF-8 is one task, and a broken one rejected whole. ``file``
    names where a record comes from.
    """
    if layout not in ("lines", "array"):
        raise ValueError("layout must be 'lines' or 'array'")
    if layout == "array" and encoding.upper() == "UTF-8":
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED}
        read = array_records(spark, path).select("file", F.from_json("record", delivered_schema(REJECTED), options).alias("r"))
        return read.select("r.*", F.col("file").alias(FILE))
    rows = (
        spark.read.schema(delivered_schema(REJECTED))
        .option("multiLine", layout == "array")
        .option("encoding", encoding)
        .option("columnNameOfCorruptRecord", REJECTED)
        .json(path)
    )
    return rows.select("*", F.col("_metadata.file_path").alias(FILE))


def _rejected() -> Column:
    """The rejected text, else null. No kind is empty: the second part only makes every query read a field, which Spark
    asks for beside the rejected text."""
    return F.coalesce(F.col(REJECTED), F.when(F.schema_of_variant("ticket_id") == "", ""))


def read_raw(spark: SparkSession, path: str, layout: str = "lines", encoding: str = "UTF-8") -> DataFrame:
    """Readable records with string fields, and in ``_wrong_kind`` the text and list fields that hold another kind of value."""
    records = read_records(spark, path, layout, encoding).where(_rejected().isNull())
    return records.select(
        *(F.try_variant_get(name, "$", dtype.simpleString()).alias(name) for name, dtype in raw_types().items()),
        wrong_kinds(FIELD_TYPES).alias(WRONG_KIND),
    )


def read_rejects(spark: SparkSession, path: str, layout: str = "lines", encoding: str = "UTF-8") -> DataFrame:
    """(ticket_id, record, file): the text of every line, or array file, that is no JSON record, and its id if readable."""
    records = read_records(spark, path, layout, encoding).where(_rejected().isNotNull())
    found = F.try_variant_get("ticket_id", "$", "string").alias("ticket_id")
    return records.select(found, F.col(REJECTED).alias("record"), F.col(FILE).alias("file"))


def read_tickets(spark: SparkSession, path: str, layout: str = "lines", encoding: str = "UTF-8") -> DataFrame:
    """Typed tickets: ``created_at`` is a point in time, ``created_wall`` the same as written, for counting by day."""
    return typed(read_raw(spark, path, layout, encoding))


def land_tickets(
    spark: SparkSession, source: str, target: str, layout: str = "array", partitions: int | None = None,
    rejects: str | None = None,
) -> DataFrame:
    """Convert JSON to typed Parquet once, so that every later job reads columns in parallel.

    What is no record goes to the table ``rejects``; without one, a rejected record stops the job.
    """
    lost = read_rejects(spark, source, layout)
    if rejects is not None:
        lost.write.mode("overwrite").parquet(rejects)
    elif lost.limit(1).collect():
        raise QualityError(f"{source} holds text that is no record; name a table for rejects")
    tickets = read_tickets(spark, source, layout)
    (tickets.repartition(partitions) if partitions else tickets).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def flatten_structs(df: DataFrame) -> DataFrame:
    """Replace nested objects by columns with dotted names, at any depth."""
    def leaves(schema, path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            here = (*path, f.name)
            if f.dataType.typeName() == "struct":
                out += leaves(f.dataType, here)
            else:
                source = ".".join(f"`{p}`" for p in here)
                out.append(F.col(source).alias(".".join(here)))
        return out

    return df.select(leaves(df.schema, ()))


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits as one table with a ``split`` column; columns missing in one split are null there."""
    frames = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def sample_ticket(
    tickets: DataFrame, category: str | None = None, index: int | None = None, seed: int = 42, id_col: str = "ticket_id"
) -> DataFrame:
    """One ticket of the pool: by position in id order, or picked by seeded hash order."""
    pool = tickets
    if category is not None:
        wanted = F.lower(strip(F.lit(category)))
        pool = tickets.where(F.lower(strip(F.coalesce("category", F.lit("")))) == wanted)
    if index is None:
        return pool.orderBy(seeded_hash(seed, id_col), id_col).limit(1)
    if index < 0:
        raise IndexError("ticket index must not be negative")
    return pool.orderBy(id_col).offset(index).limit(1)


def pick_ticket(tickets: DataFrame, **choice) -> dict:
    """``sample_ticket`` as a record; an empty pool or an index beyond it is an error."""
    row = sample_ticket(tickets, **choice).first()
    if row is None:
        raise LookupError("no ticket with this category and position")
    return row.asDict(recursive=True)
