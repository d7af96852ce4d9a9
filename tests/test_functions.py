from pyspark.sql import functions as F

from ticketlake.functions import coerce, tags, text


def column(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def collect(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_sentiment_classes(spark):
    phrases = ["Very Frustrated", "angry", "unhappy", "happy", "dissatisfied", "not good", "greatly upset", "calm", "", None]
    expected = ["negative", "negative", "negative", "positive", "positive", "positive", "negative", "neutral", "neutral", "unknown"]
    assert collect(column(spark, phrases), tags.sentiment_class("v")) == expected


def test_heuristics(spark):
    words = ["an ERROR", "fails", "Issue", "crash", "it is broken", "failing", "bug", "all fine"]
    df = column(spark, words)
    structured = collect(df, tags.structured_sentiment(F.lit(""), F.col("v")))
    assert structured == ["frustrated"] * 6 + ["neutral", "neutral"]
    assert collect(df, tags.text_sentiment(F.lit(""), F.col("v"))) == [
        "frustrated", "frustrated", "frustrated", "neutral", "neutral", "frustrated", "frustrated", "neutral"
    ]
    urgent = column(spark, ["P0 outage", "Critical", "URGENT", "severe", "soon"])
    assert collect(urgent, tags.text_priority(F.lit(None).cast("string"), F.col("v"))) == ["high"] * 4 + ["medium"]
    flags = column(spark, [True, False, None], "boolean")
    assert collect(flags, tags.structured_priority("v")) == ["high", "medium", "medium"]


def test_tokens_and_bigrams(spark):
    df = column(spark, ["Éa b12 x_y Z", "a1 b1 c1", "one", "", None])
    assert collect(df, text.tokens("v")) == [["éa", "b12", "x_y"], ["a1", "b1", "c1"], ["one"], [], []]
    assert collect(df, text.with_bigrams(text.tokens("v"))) == [
        ["éa", "b12", "x_y", "éa b12", "b12 x_y"], ["a1", "b1", "c1", "a1 b1", "b1 c1"], ["one"], [], []
    ]


def test_strip_removes_all_whitespace(spark):
    df = column(spark, ["\t  a b \r\n ", "\u001f\u0085", None])
    assert collect(df, text.strip("v")) == ["a b", "", None]


def test_concat_forms(spark):
    df = spark.createDataFrame([(" a ", None, "", "x\r\n\t y")], "s string, d string, e string, t string")
    row = df.select(
        text.concat_training("s", "d", "e", "t"), text.concat_compact("s", "d", "e", "t"),
        text.concat_separated("s", "d", "e", "t"), text.concat_normalized("s", "d", "e", "t"),
    ).first()
    assert tuple(row) == (" a    x\r\n\t y", "a x\r\n\t y", "a \n  \n  \n x\r\n\t y", "a x y")


def test_fingerprint_keeps_case_and_blanks(spark):
    df = spark.createDataFrame([("A", None), ("a", ""), ("a ", "")], "s string, d string")
    a, b, c = [r[0] for r in df.select(text.fingerprint("s", "d")).collect()]
    assert len({a, b, c}) == 3
    import hashlib

    assert a == hashlib.md5(b"A||").hexdigest()


def test_kb_text_and_articles(spark):
    schema = (
        "subject string, product string, category string, subcategory string, tags array<string>, resolution_code string, "
        "kb_articles_helpful array<string>, kb_articles_viewed array<string>, resolution string, description string"
    )
    rows = [("s", "p", "c", None, ["t1", "t2"], "", [], ["a"], None, "d "), ("s", None, "c", "u", None, "r", None, None, "f", "d")]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(text.kb_text()).collect()]
    assert got == ["s p c  t1 t2  a  d", "s  c u  r  f d"]


def test_online_features(spark):
    rows = [("x ERROR_9", "an Error here", "", None), ("s", None, "error", None)]
    df = spark.createDataFrame(rows, "subject string, description string, product string, customer_tier string")
    df = df.withColumns({"error_logs": F.lit(None).cast("string"), "stack_trace": F.lit("")})
    got = df.select(*tags.online_features()).collect()
    assert [(r["product"], r["tier"], r["has_error_code"]) for r in got] == [("unknown", "unknown", True), ("error", "unknown", False)]
    assert got[1]["text"] == "s\n\n\n"


def test_coercion(spark):
    df = column(spark, ["12", "12x", None, "nan", "-inf"])
    assert collect(df, coerce.number_or_zero("v"))[:3] == [12.0, 0.0, 0.0]
    assert collect(df, coerce.finite_or_null(coerce.number_or_zero("v")))[3:] == [None, None]
    days = column(spark, ["2024-01-28T23:46:19-05:00", "2024-01-28", "nope", None])
    assert [str(d) for d in collect(days, coerce.wall_clock_day("v"))] == ["2024-01-28", "2024-01-28", "None", "None"]
    instants = collect(days, F.date_format(coerce.instant("v"), "yyyy-MM-dd HH"))
    assert instants == ["2024-01-29 04", "2024-01-28 00", None, None]
    flags = column(spark, ["true", "false", "maybe", None])
    assert collect(flags, coerce.flag_or_null("v")) == [1.0, 0.0, None, None]
    assert collect(flags, coerce.flag_or_zero("v")) == [1.0, 0.0, 0.0, 0.0]


def test_category_label(spark):
    assert collect(column(spark, [" a ", "  ", None]), text.category_label("v")) == ["a", "<MISSING>", "<MISSING>"]


def test_solve_summary_without_hit(spark):
    df = spark.createDataFrame([(None,)], "hit struct<doc_id:string,category:string,subcategory:string,resolution_code:string>")
    assert df.select(text.solve_summary(F.col("hit"))).first()[0] == text.NO_MATCH
