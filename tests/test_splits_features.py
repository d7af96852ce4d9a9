import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ticketlake.functions import text
from ticketlake.operators import features, projection, ranking, splits


def hashed(spark, n=400, copies=3):
    return spark.range(n).select(F.col("id").cast("string").alias("ticket_id"), F.concat(F.lit("h"), F.floor(F.col("id") / copies)).alias("text_hash"))


@pytest.mark.parametrize("split", [splits.grouped_split, splits.grouped_split_exact])
def test_copies_never_cross_splits(spark, split):
    got = split(hashed(spark), "text_hash")
    overlap = splits.leakage_overlap(got).first()
    assert (overlap["train_val"], overlap["train_test"], overlap["val_test"]) == (0, 0, 0)
    assert got.count() == 400
    again = split(hashed(spark).repartition(7), "text_hash")
    assert sorted(map(tuple, got.select("ticket_id", "split").collect())) == sorted(map(tuple, again.select("ticket_id", "split").collect()))


def test_exact_split_has_exact_group_counts(spark):
    got = splits.grouped_split_exact(hashed(spark, 100, 1), "text_hash")
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 70, "val": 15, "test": 15}


def test_overlap_counts_hashes_not_rows(spark):
    rows = [("h1", "train"), ("h1", "train"), ("h2", "train"), ("h2", "val"), ("h3", "test")]
    row = splits.leakage_overlap(spark.createDataFrame(rows, "text_hash string, split string")).first()
    assert tuple(row[c] for c in ("n_train", "n_val", "n_test", "train_val", "train_test", "val_test")) == (2, 1, 1, 1, 0, 0)


def brute_temporal(rows):
    import hashlib

    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append(r)
    out = {}
    for members in groups.values():
        members.sort(key=lambda r: (r[3] is not None, r[3] or dt.datetime.min, hashlib.md5(r[0].encode()).hexdigest()[:8], r[0]))
        n = len(members)
        a, b = int(n * 0.7), int(n * 0.15)
        for i, r in enumerate(members):
            out[r[0]] = "train" if i < a else "val" if i < a + b else "test"
    return out


def test_temporal_split_matches_sorting(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        hot = i % 3 > 0  # one stratum holds most rows, many of them with one time or none
        moment = None if i % 5 == 0 else base + dt.timedelta(days=i % 4, microseconds=(i * 37) % 11)
        rows.append((str(i), "hot" if hot else f"c{i % 7}", None if i % 2 else "s", moment))
    rows += [("only", "one", "one", None)]
    df = spark.createDataFrame(rows, "ticket_id string, category string, subcategory string, created_at timestamp_ntz")
    got = {r["ticket_id"]: r["split"] for r in splits.stratified_temporal_split(df).select("ticket_id", "split").collect()}
    assert got == brute_temporal(rows)


@pytest.mark.parametrize("n,expected", [(10, (7, 1, 2)), (3, (2, 0, 1)), (1, (0, 0, 1))])
def test_temporal_split_sizes(spark, n, expected):
    rows = [(str(i), "c", "s", dt.datetime(2024, 1, 1 + i)) for i in range(n)]
    df = spark.createDataFrame(rows, "ticket_id string, category string, subcategory string, created_at timestamp_ntz")
    counts = {r["split"]: r["count"] for r in splits.stratified_temporal_split(df).groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in splits.SPLITS) == expected


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        splits.stratified_temporal_split(hashed(spark), ratios=(0.5, 0.1, 0.1))


def test_hash_rank_is_a_permutation_in_hash_order(spark):
    import hashlib

    got = ranking.hash_rank(hashed(spark), ["ticket_id"], 9).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 401))
    assert [r["ticket_id"] for r in got] == sorted((str(i) for i in range(400)), key=lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest())


def test_shuffled_labels_are_a_permutation(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("y"))
    got = splits.shuffle_labels(df, "id", "y").collect()
    assert sorted(r["y"] for r in got) == sorted(r["shuffled"] for r in got) and len({r["id"] for r in got}) == 300
    assert 0.2 < sum(r["y"] == r["shuffled"] for r in got) / 300 < 0.47


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_idf_and_min_df(spark):
    corpus = docs(spark, "aa bb", "aa cc")
    words = corpus.withColumn("terms", text.tokens("text"))
    got = {r["term"]: r["idf"] for r in features.vocabulary(words, 1, 10).withColumn("idf", features.idf_of("df", 2)).collect()}
    assert got == pytest.approx({"aa": 1.0, "bb": math.log(1.5) + 1, "cc": math.log(1.5) + 1})
    model = features.fit_tfidf(corpus, "text", 10, 2, False)
    assert model.terms == ["aa"]
    assert [r["val"] for r in model.transform(corpus, "text").collect()] == [[1.0], [1.0]]


def test_sublinear_weights_and_unit_norm(spark):
    corpus = docs(spark, "aa aa aa bb", "aa bb cc", "")
    model = features.fit_tfidf(corpus, "text", 100, 1, True)
    rows = {r["doc_id"]: dict(zip([model.terms[i] for i in r["idx"]], r["val"])) for r in model.transform(corpus, "text").collect()}
    idf = dict(zip(model.terms, model.idf))
    assert rows[0]["aa"] / rows[0]["bb"] == pytest.approx((1 + math.log(3)) * idf["aa"] / idf["bb"])
    assert rows[0]["aa aa"] / rows[0]["bb"] == pytest.approx((1 + math.log(2)) * idf["aa aa"] / idf["bb"])
    for weights in (rows[0], rows[1]):
        assert sum(w * w for w in weights.values()) == pytest.approx(1.0)
    assert rows[2] == {}
    packed = {r["doc_id"]: r["v"] for r in model.transform_vector(corpus, "text", "v").collect()}
    assert packed[1].numNonzeros() == len(rows[1])


def test_vocabulary_cut_keeps_smaller_term_on_ties(spark):
    words = docs(spark, "bb aa cc cc").withColumn("terms", text.tokens("text"))
    assert [r["term"] for r in features.vocabulary(words, 1, 2).orderBy("term").collect()] == ["aa", "cc"]


def test_model_survives_saving(spark, tmp_path):
    model = features.fit_tfidf(docs(spark, "aa bb", "bb cc"), "text", 10, 1, True)
    model.save(spark, str(tmp_path / "m"))
    assert features.TfidfModel.load(spark, str(tmp_path / "m")) == model


def test_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (None, 5.0)], "a double, b double")
    assert features.scale_divisors(df, ["a", "b"]) == pytest.approx({"a": 1.247219, "b": 1.0}, abs=1e-6)
    scaled = features.scale_numeric(df, df, ["a", "b"]).collect()
    assert scaled[3]["a"] is None and scaled[0]["b"] == 5.0


def test_label_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "y string")
    classes = features.label_classes(train, "y")
    assert {r["class"]: r["code"] for r in classes.collect()} == {"a": 0, "b": 1, "c": 2, "unknown": 3}
    back = features.decode_labels(features.encode_labels(train, classes, "y"), classes, "code", "again")
    assert all(r["again"] == (r["y"] or "unknown") for r in back.collect())
    with pytest.raises(Exception, match="unseen label"):
        features.encode_labels(spark.createDataFrame([("z",)], "y string"), classes, "y").collect()


def test_one_hot_ignores_unseen_and_counts_null(spark):
    train = spark.createDataFrame([(1, "a"), (2, None)], "id int, c string")
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, c string")
    got = {(r["id"], r["feature"]) for r in features.one_hot_long(train, rows, "id", ["c"]).collect()}
    assert got == {(1, "c=a"), (2, "c=<null>")}


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    matrix = rng.random((30, 8)) * (rng.random((30, 8)) > 0.4)
    rows = [(i, Vectors.sparse(8, [(j, float(x)) for j, x in enumerate(r) if x])) for i, r in enumerate(matrix)]
    df = spark.createDataFrame(rows, ["id", "v"])
    svd = projection.fit_svd(df, "v", 3)
    assert svd.singular_values == pytest.approx(np.linalg.svd(matrix, compute_uv=False)[:3], rel=1e-6)
    idx, val = projection.vector_parts("v")
    dense = svd.transform(df.withColumns({"idx": idx, "val": val})).orderBy("id").collect()
    assert np.allclose([r["dense"] for r in dense], matrix @ svd.panel(slice(0, 3)))


def test_center_scale(spark):
    df = spark.createDataFrame([([1.0, 7.0],), ([3.0, 7.0],)], "x array<double>")
    got = features.fit_center_scale(df, "x").transform(df, "x", "z").collect()
    assert [r["z"] for r in got] == [[-1.0, 0.0], [1.0, 0.0]]
