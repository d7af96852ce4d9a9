"""TF-IDF, one-hot, scaling, label codes and dense projections."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType

from ticketlake.functions.text import tokens, with_bigrams
from ticketlake.session import materialize

# Fixed values: (max_features, min_df, sublinear term counts) of the three vectorisers.
CLASSIFIER_TEXT = {"max_features": 120_000, "min_df": 3, "sublinear": True}
NETWORK_TEXT = {"max_features": 50_000, "min_df": 2, "sublinear": False}
KNOWLEDGE_BASE_TEXT = {"max_features": 20_000, "min_df": 2, "sublinear": False}
UNKNOWN = "unknown"

_WORDS = 1 << 20  # words of texts that are weighed at once
_VECTOR = pa.struct({"type": pa.int8(), "size": pa.int32(), "indices": pa.list_(pa.int32()), "values": pa.list_(pa.float64())})


def with_terms(df: DataFrame, text: Column | str, out: str = "terms") -> DataFrame:
    """Add the array of one- and two-word terms of a text."""
    return df.withColumn("_words", tokens(text)).withColumn(out, with_bigrams(F.col("_words"))).drop("_words")


def vocabulary(with_terms: DataFrame, min_df: int, max_features: int, terms: str = "terms") -> DataFrame:
    """(term, df, total): terms of at least min_df documents, the most frequent max_features of them.

    A document is one row, so its distinct terms are known in place; document frequency and total are then
    two counts of one map-side-combined aggregation and the only exchange is by term. Ties on the total go
    to the smaller term.

    The total at which the limit falls is read off the (small) table of how many terms have each total, so
    the final ordering sees the kept terms and the ties at the cut, not max_features terms per partition.
    """
    listed = with_terms.select(F.col(terms).alias("all"), F.array_distinct(terms).alias("distinct"))
    # The distinct terms come first, so the position tells which of the two counts a term adds to.
    marked = listed.select(F.size("distinct").alias("n"), F.posexplode(F.concat("distinct", "all")).alias("pos", "term"))
    counted = marked.groupBy("term").agg(
        F.count_if(F.col("pos") < F.col("n")).alias("df"), F.count_if(F.col("pos") >= F.col("n")).alias("total")
    )
    return _most_frequent(counted, min_df, max_features)


def _total_at(frequent: DataFrame, max_features: int) -> int:
    """The total of the term at which the limit falls, 0 if there are fewer terms."""
    from_top = Window.orderBy(F.col("total").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = frequent.groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    return (
        totals.select("total", F.sum("n").over(from_top).alias("upto"))
        .where(F.col("upto") >= max_features)
        .agg(F.coalesce(F.max("total"), F.lit(0)))
        .scalar()
    )


def _most_frequent(counted: DataFrame, min_df: int, max_features: int) -> DataFrame:
    frequent = counted.where(F.col("df") >= min_df)
    kept = frequent.where(F.col("total") >= _total_at(frequent, max_features))
    return kept.orderBy(F.col("total").desc(), "term").limit(max_features)


def text_vocabulary(df: DataFrame, text: Column | str, min_df: int, max_features: int) -> DataFrame:
    """``vocabulary`` of the one- and two-word terms of a text, from its words.

    No pair is more frequent than its words. Words are counted first; if max_features of them reach some total, pairs
    with a rarer word cannot be in the vocabulary and are not counted: most pairs of a text are rare. A word list longer
    than some vocabularies, as by many ties, is not sent to the tasks; all pairs are counted then.
    """
    words = df.select(tokens(text).alias("words"))

    def counted(run: Callable) -> DataFrame:
        parts = words.mapInArrow(run, "term string, df bigint, total bigint")
        return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where(F.col("df") >= min_df)

    single = materialize(counted(_word_counts), "word-counts")
    able = single.where(F.col("total") >= _total_at(single, max_features)).select("term")
    listed = [r["term"] for r in able.limit(4 * max_features + 1).collect()]
    sent = df.sparkSession.sparkContext.broadcast(listed if len(listed) <= 4 * max_features else None)
    return _most_frequent(single.unionByName(counted(_pair_counts(sent))), min_df, max_features)


def _counts(code: np.ndarray, ends: list[int], n: int) -> tuple[pa.Array, pa.Array]:
    """Documents that hold each of ``n`` codes, and its places; a document's places end where the next one's begin."""
    place, at, counted, start = np.zeros(n, np.int32), np.arange(len(code), dtype=np.int32), np.zeros(len(code), bool), 0
    for end in ends:
        # Of a code's places in a document only the last one keeps its number.
        place[code[start:end]] = at[start:end]
        counted[start:end] = place[code[start:end]] == at[start:end]
        start = end
    return pa.array(np.bincount(code[counted], minlength=n), pa.int64()), pa.array(np.bincount(code, minlength=n), pa.int64())


_COUNTED = ["term", "df", "total"]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, total) of the words of the documents of a batch."""
    for batch in batches:
        words = batch.column(0).flatten().dictionary_encode()
        ends = np.cumsum(batch.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        counts = _counts(words.indices.to_numpy(zero_copy_only=False), ends, len(words.dictionary))
        yield pa.RecordBatch.from_arrays([words.dictionary, *counts], names=_COUNTED)


def _pair_counts(sent) -> Callable:
    """(term, df, total) of the pairs of neighbours, both of them among the words sent, of the documents of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able = None if sent.value is None else pa.array(sent.value, pa.string())
        for batch in batches:
            words = batch.column(0).flatten().dictionary_encode()
            code, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary
            sizes = batch.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            has_next = np.ones(len(code), bool)
            has_next[ends[sizes > 0] - 1] = False
            if able is not None:
                known = pc.is_in(names, able).to_numpy(zero_copy_only=False)[code]
                has_next[:-1] &= known[:-1] & known[1:]
            left = np.flatnonzero(has_next)
            pairs = pa.array(code[left].astype(np.int64) * len(names) + code[left + 1], pa.int64()).dictionary_encode()
            first, second = np.divmod(pairs.dictionary.to_numpy(), max(len(names), 1))
            terms = pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), " ")
            counts = _counts(pairs.indices.to_numpy(zero_copy_only=False), np.searchsorted(left, ends).tolist(), len(terms))
            yield pa.RecordBatch.from_arrays([terms, *counts], names=_COUNTED)

    return run


def idf_of(df_col: str, n_docs: Column | int) -> Column:
    """Smoothed inverse document frequency ln((1+N)/(1+df)) + 1."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log((1.0 + n) / (1.0 + F.col(df_col))) + 1.0


class _TermWeights:
    """A vectoriser's terms as numbers: words, pairs of words, and the weights of both."""

    def __init__(self, terms: list[str], idf: list[float], sublinear: bool):
        parts = [t.split(" ") for t in terms]
        names = sorted({w for p in parts for w in p})
        number = {w: i for i, w in enumerate(names)}
        self.words, self.n, self.idf, self.sublinear = pa.array(names, pa.string()), len(names), np.array(idf, "float64"), sublinear
        self.single = np.full(self.n + 1, -1)
        codes, places = [], []
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.single[number[p[0]]] = i
            else:
                codes.append(number[p[0]] * self.n + number[p[1]])
                places.append(i)
        order = np.argsort(codes)
        # One more than any pair at the end, so that every search ends inside.
        self.pairs = np.append(np.array(codes, "int64")[order], self.n * self.n)
        self.pair_terms = np.append(np.array(places, "int64")[order], -1)

    def vectors(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the rows, positions and weights of unit length, positions ascending."""
        sizes = pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False).astype("int64")
        flat = words.flatten().dictionary_encode()
        # Words of no term have the last number.
        known = pc.fill_null(pc.index_in(flat.dictionary, self.words), self.n).to_numpy(zero_copy_only=False).astype("int64")
        word, row = known[flat.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(sizes)), sizes)
        left = np.flatnonzero((row[:-1] == row[1:]) & (word[:-1] < self.n) & (word[1:] < self.n))
        code = word[left] * self.n + word[left + 1]
        at = np.searchsorted(self.pairs, code)
        term = np.concatenate([self.single[word], np.where(self.pairs[at] == code, self.pair_terms[at], -1)])
        row = np.concatenate([row, row[left]])
        width = max(len(self.idf), 1)
        key, count = np.unique((row * width + term)[term >= 0], return_counts=True)
        row, term = np.divmod(key, width)
        value = self.idf[term] * (1.0 + np.log(count) if self.sublinear else count)
        norm = np.sqrt(np.bincount(row, value * value, len(sizes)))
        return np.searchsorted(row, np.arange(len(sizes) + 1)), term.astype("int32"), value / norm[row]


def _vectoriser(sent, size: int):
    """Arrow function from the words of texts to sparse ML vectors."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = _TermWeights(*sent.value)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(batch.value_lengths(), 0).to_numpy(zero_copy_only=False))
            out, a = [], 0
            while a < len(batch):
                # Texts of some words at a time; one text at least.
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _WORDS, "right")))
                edges, term, value = weights.vectors(batch.slice(a, b - a))
                kind, length = np.zeros(b - a, "int8"), np.full(b - a, size, "int32")
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x)) for x in (term, value)]
                out.append(pa.StructArray.from_arrays([pa.array(kind), pa.array(length), *lists], names=["type", "size", "indices", "values"]))
                a = b
            yield pa.concat_arrays(out) if out else pa.array([], _VECTOR)

    return F.arrow_udf(run, VectorUDT())


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vectoriser: its terms in alphabetical order and their weights.

    The size is bounded by max_features, so the term list travels to the executors as one small
    broadcast and a document becomes a vector inside its own row: no join and no exchange.
    """

    terms: list[str]
    idf: list[float]
    sublinear: bool
    _sent: list = field(default_factory=list, repr=False, compare=False)

    def transform(self, df: DataFrame, text: Column | str) -> DataFrame:
        """Add ``idx`` (term positions, ascending) and ``val`` (weights of unit length)."""
        if not self.terms:
            return df.withColumns({"idx": F.array().cast("array<int>"), "val": F.array().cast("array<double>")})
        v = F.unwrap_udt("_v")
        return self.transform_vector(df, text, "_v").withColumns({"idx": v["indices"], "val": v["values"]}).drop("_v")

    def transform_vector(self, df: DataFrame, text: Column | str, out: str) -> DataFrame:
        """The same weights as one sparse ML vector column."""
        if not self.terms:
            return self.transform(df, text).withColumn(out, to_sparse_vector(1)("idx", "val")).drop("idx", "val")
        if not self._sent:
            self._sent.append(df.sparkSession.sparkContext.broadcast((self.terms, self.idf, self.sublinear)))
        return df.withColumn(out, _vectoriser(self._sent[0], len(self.terms))(tokens(text)))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(t, w, self.sublinear) for t, w in zip(self.terms, self.idf)]
        spark.createDataFrame(rows, "term string, idf double, sublinear boolean").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TfidfModel":
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["term"])
        return TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows], bool(rows) and rows[0]["sublinear"])


def fit_tfidf(train: DataFrame, text: Column | str, max_features: int, min_df: int, sublinear: bool) -> TfidfModel:
    n_docs = train.count()
    rows = (
        text_vocabulary(train, text, min_df, max_features)
        .select("term", idf_of("df", n_docs).alias("idf"))
        .collect()  # at most max_features rows
    )
    rows.sort(key=lambda r: r["term"])
    return TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows], sublinear)


def postings(vectors: DataFrame, model: TfidfModel, id_col: str) -> DataFrame:
    """Long form (id, term, weight) of vectorised rows."""
    spark = vectors.sparkSession
    terms = spark.createDataFrame(list(enumerate(model.terms)), "i int, term string")
    long = vectors.select(id_col, F.inline(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("weight"))))
    return long.join(F.broadcast(terms), "i").select(id_col, "term", "weight")


def to_sparse_vector(size: int):
    """Column function that packs positions and weights into one ML vector, without leaving the JVM.

    A vector is stored as a struct, and Spark's JSON reader takes a struct for a column whose type is the vector. Doubles
    are written so that they read back equal.
    """
    schema = StructType([StructField("v", VectorUDT())])

    def pack(idx: Column | str, val: Column | str) -> Column:
        idx, val = (F.col(c) if isinstance(c, str) else c for c in (idx, val))
        stored = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), idx.alias("indices"), val.alias("values"))
        return F.from_json(F.to_json(F.struct(stored.alias("v"))), schema)["v"]

    return pack


def one_hot_long(train: DataFrame, rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, feature) with feature ``column=value`` for each value seen in training; a null value is a category.

    The seen values are a written table, so the lookup is broadcast when the value list is small.
    """
    def long(df: DataFrame, *keep: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        return df.select(*keep, F.inline(pairs))

    seen = materialize(long(train).distinct().withColumnsRenamed({"column": "_column", "value": "_value"}), "seen-values")
    feature = F.concat(F.col("column"), F.lit("="), F.coalesce("value", F.lit("<null>")))
    return (
        long(rows, id_col)
        .join(seen, (F.col("column") == F.col("_column")) & F.equal_null(F.col("value"), F.col("_value")))
        .select(id_col, feature.alias("feature"), F.lit(1.0).alias("value"))
    )


def scale_divisors(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Population standard deviation per column, 1 for a constant column; nulls are ignored."""
    row = train.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: (row[c] if row[c] else 1.0) for c in columns}


def scale_numeric(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Divide each column by its training deviation; no centring, nulls stay null."""
    divisors = scale_divisors(train, columns)
    return rows.withColumns({c: F.col(c).cast("double") / F.lit(divisors[c]) for c in columns})


def label_classes(train: DataFrame, label: str) -> DataFrame:
    """(class, code): sorted distinct labels of the training rows, null counted as ``unknown``."""
    distinct = train.select(F.coalesce(F.col(label).cast("string"), F.lit(UNKNOWN)).alias("class")).distinct()
    coded = distinct.select("class", (F.row_number().over(Window.orderBy("class")) - 1).cast("bigint").alias("code"))
    return materialize(coded, "label-classes")


def encode_labels(rows: DataFrame, classes: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Add the class code; a label that training never saw is an error."""
    lookup = classes.select(F.col("class").alias("_class"), F.col("code").alias("_code"))
    name = F.coalesce(F.col(label).cast("string"), F.lit(UNKNOWN))
    joined = rows.withColumn("_name", name).join(lookup, F.col("_name") == F.col("_class"), "left")
    code = F.coalesce(F.col("_code"), F.raise_error(F.concat(F.lit("unseen label: "), F.col("_name"))).cast("bigint"))
    return joined.withColumn(out, code).drop("_name", "_class", "_code")


def decode_labels(rows: DataFrame, classes: DataFrame, code: str, out: str) -> DataFrame:
    lookup = classes.select(F.col("code").alias("_code"), F.col("class").alias(out))
    return rows.join(lookup, F.col(code) == F.col("_code"), "left").drop("_code")


def feature_metadata(df: DataFrame, split: str, category: str, subcategory: str) -> DataFrame:
    """Rows per split with the number of distinct labels of each target."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.coalesce(F.col(category), F.lit(UNKNOWN))).alias("n_category"),
        F.count_distinct(F.coalesce(F.col(subcategory), F.lit(UNKNOWN))).alias("n_subcategory"),
    )


@dataclass(frozen=True)
class CenterScaleModel:
    """Mean and population deviation per position of a dense array; the size is the array length."""

    mean: list[float]
    std: list[float]

    def transform(self, df: DataFrame, values: str, out: str) -> DataFrame:
        mean, std = F.lit(self.mean), F.lit(self.std)
        centred = F.zip_with(F.col(values).cast("array<double>"), mean, lambda x, m: x - m)
        return df.withColumn(out, F.zip_with(centred, std, lambda x, s: x / s))


def fit_center_scale(train: DataFrame, values: str) -> CenterScaleModel:
    """Per-position statistics by one partial aggregation of whole vectors."""
    vector = array_to_vector(F.col(values).cast("array<double>"))
    found = train.where(F.col(values).isNotNull()).agg(Summarizer.metrics("mean", "variance", "count").summary(vector).alias("s")).first()["s"]
    if found is None or not found["count"]:
        return CenterScaleModel([], [])
    # The summary divides by n - 1.
    population = (found["count"] - 1) / found["count"]
    std = [(float(x) * population) ** 0.5 for x in found["variance"].toArray()]
    return CenterScaleModel([float(x) for x in found["mean"].toArray()], [x or 1.0 for x in std])
