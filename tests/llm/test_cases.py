"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import os

import pytest

import corpus_pipeline
from ticketlake.llm import decontamination, embeddings, html_text, licences, minhash, packing, quality, secret_scan, toxicity, warc
from ticketlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000 + "mit license token = abcdefgh12345678"
DOCS = "doc_id bigint, id string, text string, key int, component string, score double, n bigint, y int, label string, n_chars bigint"
ROWS = [
    (1, "a", "the quick brown fox jumps over the lazy dog", 1, None, None, None, 0, None, None), (1, "a", "the quick brown fox jumps over the lazy dog", 1, None, None, None, 0, None, None),
    (2, None, None, None, "c", 0.5, 3, 1, "l", 0), (3, "b", "", 1, "c", 0.5, 3, 1, "l", 0), (4, "b", LONG, 1, "c", 0.5, 3, 1, "l", 0),
    (None, "b", "a row without id but with words enough", 1, "c", 0.5, 3, 1, "l", 0), (5, "b", "\x00퟿ \n\t", 1, "c", 0.5, 3, 1, "l", 0), (1, "z", "the same id with another text here now", 2, "c", 0.5, 3, 1, "l", 0),
]
LABELS = "doc_id bigint, quality int, toxic int, id string"
LABEL_ROWS = [(1, 1, 0, "x"), (1, 1, 0, "x"), (1, 0, 1, "x"), (2, None, None, None), (3, 0, 0, "y"), (None, 1, 1, "z"), (4, 1, 7, "q")]
BENCH = "item_id bigint, text string, id int, hash string"
BENCH_ROWS = [(1, "quick brown fox jumps over the lazy", 1, "h"), (1, "quick brown fox jumps over the lazy", 1, "h"), (2, None, 1, "h"), (None, "fox jumps over the lazy dog", 1, "h"), (3, "", 1, None)]

PER_ROW = {
    "minhash": lambda d, lab, b: minhash.near_duplicates(d), "packing": lambda d, lab, b: packing.pack_documents(d).filter("start = 0"),
    "toxicity": lambda d, lab, b: toxicity.score_toxicity(d, lab), "licences": lambda d, lab, b: licences.scan_licences(d),
    "quality": lambda d, lab, b: quality.score_quality(d, lab), "secrets": lambda d, lab, b: secret_scan.scan_secrets(d),
}


@pytest.fixture()
def tables(spark):
    return spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(LABEL_ROWS, LABELS), spark.createDataFrame(BENCH_ROWS, BENCH)


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_every_row_has_a_result(spark, tables, name):
    docs, labels, bench = tables
    got = PER_ROW[name](docs, labels, bench).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert PER_ROW[name](docs.limit(0), labels.limit(0), bench.limit(0)).count() == 0
    assert PER_ROW[name](docs, labels.limit(0), bench).count() == len(ROWS)


def test_repeated_and_missing_ids(spark, tables):
    got = minhash.near_duplicates(tables[0]).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)
    none = [r for r in got if r["doc_id"] is None]
    assert len(none) == 1 and none[0]["n_shingles"] == 4


def test_scores_without_labels(spark, tables):
    docs, labels, _ = tables
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_decontamination_cases(spark, tables):
    docs, _, bench = tables
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()] == [(1, 1)]
    assert decontamination.contaminated(docs, bench.limit(0)).count() == decontamination.contaminated(docs.limit(0), bench).count() == 0
    rest = decontamination.without_benchmark(docs, bench)
    assert rest.columns == docs.columns and rest.filter("doc_id is null").count() == 1 and rest.count() == len(ROWS) - 3


def test_page_cases(spark, tmp_path):
    rows = [(1, None, None, "t", 1), (1, None, None, "t", 1), (None, "u", "<p>x", None, None), (2, "u", "<" * 50_000 + "<a '", "t", 1), (3, "u", "<p>" + "w " * 200_000, "t", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, id int")
    assert html_text.extract_text(pages).count() == html_text.extract_text(pages.select("*")).count() == len(rows)
    assert html_text.extract_text(pages.limit(0)).count() == 0
    assert warc.archive_round_trip(spark, pages).count() == len(rows)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_vector_cases(spark):
    rows = [(1, [1.0, 0.0], 1, 0), (1, [1.0, 0.0], 1, 0), (2, [1.0, 0.0], 1, 0), (None, [1.0, 0.0], 1, 0), (3, [], 1, 0), (4, [1e300, 1e300], 1, 0), (5, [1e-300, 1e-300], 1, 0), (6, [float("inf"), 1.0], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, id int")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect())
    assert got == [("1", 1, 1, True), ("1", 1, 1, True), ("2", 1, 1, False), ("3", 0, 3, True), ("4", 1, 4, True), ("5", 1, 4, False), ("6", 0, 6, True), ("None", 0, None, True)]
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_stages_take_any_table(spark, tables, tmp_path):
    docs, labels, bench = tables
    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            assert name == "packing" or out.columns == docs.columns
            out.count()
    kept = corpus_pipeline.dedup_stage(spark, docs, sf).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "5", "None"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_pipeline_equals_its_stages(spark):
    """The rows of run() against the operators' own results, stage by stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    low = {r["doc_id"] for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("score < 0.7").collect()}
    left = docs.filter(~docs["doc_id"].isin(*low)) if low else docs
    kept = {r["doc_id"] for r in minhash.near_duplicates(left).filter("kept").collect()}
    left = left.filter(left["doc_id"].isin(*kept))
    held = {r["doc_id"] for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    got = {r["doc_id"]: r["doc_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == kept - held and 0 < len(got) < docs.count()
    net, encoder = secret_scan.trained(), packing.Encoder(packing.public_paths()[0])
    for r in left.filter(left["doc_id"].isin(*got)).collect():
        text = secret_scan.redacted(r["text"], secret_scan.find_spans([r["text"]], net)[0], "[SECRET]")
        assert got[r["doc_id"]] == len(encoder.ids(text)) + 1
