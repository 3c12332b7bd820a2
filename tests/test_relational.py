from pyspark.sql import functions as F

from textlens.operators import relational as R


def test_dedupe_keeps_last(spark):
    df = spark.createDataFrame([(3, "same", "a"), (8, "same", "b"), (5, "other", "c")], "row_id long, t string, x string")
    got = sorted(tuple(r) for r in R.dedupe_keep_last(df, "t", "row_id").collect())
    assert got == [(5, "other", "c"), (8, "same", "b")]


def test_dedupe_hot_key(spark):
    # a third of all rows share one key: one survivor, the last
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, t string")
    out = R.dedupe_keep_last(df, "t", "row_id")
    assert out.count() == 2001
    assert out.filter(F.col("t") == "hot").first()["row_id"] == 2997


def test_filter_not_label_keeps_null(spark):
    df = spark.createDataFrame([(1, "positive"), (2, "neg"), (3, None)], "row_id long, s string")
    got = sorted(r[0] for r in R.filter_not_label(df, "s", "positive").collect())
    assert got == [2, 3]


def test_exclude_terms_substring(spark):
    df = spark.createDataFrame([(1, "perlu masa"), (2, "ok train")], "row_id long, t string")
    got = [r[0] for r in R.filter_exclude_terms(df, "t", ["erl", "bus"]).collect()]
    assert got == [2]


def test_exclude_authors_keeps_missing(spark):
    df = spark.createDataFrame([(1, "MyRapidKL"), (2, None), (3, "someone")], "row_id long, username string")
    got = sorted(r[0] for r in R.filter_exclude_authors(df).collect())
    assert got == [2, 3]


def test_crosstab_zero_fill(spark):
    df = spark.createDataFrame([("yes", "neg"), ("yes", "neg"), ("no", "neu")], "a string, b string")
    got = {r["a"]: (r["neg"], r["neu"]) for r in R.crosstab(df, "a", "b", ["neg", "neu"]).collect()}
    assert got == {"yes": (2, 0), "no": (0, 1)}


def test_union_periods_order(spark):
    a = spark.createDataFrame([(1, "x")], "row_id long, t string")
    b = spark.createDataFrame([(0, "x")], "row_id long, t string")
    u = R.union_periods([a, b])
    out = R.dedupe_keep_last(u, "t", ["batch_no", "row_id"]).first()
    assert (out["batch_no"], out["row_id"]) == (1, 0)


def test_list_lexicon_round_trip_many_lines(spark):
    from textlens.session import scratch_path
    from textlens.sources import files as FS
    words = spark.createDataFrame([(f"w{i}",) for i in range(250)] + [(None,)], "w string")
    p = scratch_path(spark, "lex_test")
    FS.write_list_lexicon(words, "w", p, max_terms=40)  # several lines / files
    back = sorted(r[0] for r in FS.read_list_lexicon(spark, p).select("term").collect())
    assert back == sorted(f"w{i}" for i in range(250))


def test_pair_lexicon_first_position_last_value(spark):
    from textlens.session import scratch_path
    from textlens.sources import files as FS
    rows = spark.createDataFrame([(1, "a, x"), (2, "b, y"), (3, "a, z")], "o long, line string")
    p = scratch_path(spark, "pairs_test")
    FS.write_lines_in_order(rows, "line", "o", p, n_files=2)
    got = {r["key"]: r["val"] for r in FS.read_pair_lexicon(spark, p).collect()}
    assert got == {"a": "z", "b": "y"}
