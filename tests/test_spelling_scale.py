"""Spelling compares words in many tasks and without interpreted lambdas."""

import itertools

from pyspark.sql import functions as F

from textlens.operators import linguistics as G
from textlens.plans import cleaning


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_deletes_run_compiled(spark):
    df = spark.createDataFrame([("abcdefghij",), ("ab",), ("",), (None,)], "w string")
    found = df.select("w", G.deletes(F.col("w")).alias("k"))
    assert "lambda" not in _plan(found)

    def plain(w):
        p = w[:7]
        return {"".join(c for i, c in enumerate(p) if i not in gone) for n in range(3) for gone in itertools.combinations(range(len(p)), n)}
    for r in found.collect():
        assert (r["k"] is None) if r["w"] is None else (len(set(r["k"])) == len(r["k"]) and set(r["k"]) == plain(r["w"]))


def test_words_are_compared_in_many_tasks(spark):
    words = spark.createDataFrame([("kereta",), ("tren",)], "tok string")
    terms = spark.createDataFrame([("kerete", 5), ("trem", 7)], "term string, freq long")
    pairs = G._near_pairs(words, terms, 2, 7)
    assert pairs.rdd.getNumPartitions() >= G.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert {(r["tok"], r["term"], r["dist"]) for r in pairs.collect()} == {("kereta", "kerete", 1), ("tren", "trem", 1)}


def test_nearer_words_win_over_frequent_ones(spark):
    words = spark.createDataFrame([("abcd",), ("abcd",), ("wxyz",), ("q",), (None,)], "tok string")
    terms = spark.createDataFrame([("abce", 5), ("abfg", 90), ("wxba", 6), ("wxcd", 6)], "term string, freq long")
    got = {r["tok"]: (r["best"], r["dist"]) for r in G.spell_best(words, terms).collect() if r["tok"]}
    assert got == {"abcd": ("abce", 1), "wxyz": ("wxba", 2), "q": ("q", None)}


def test_tokens_that_stay_need_no_row(spark, monkeypatch):
    """Three of the five rows change nothing, so two are joined."""
    counts, sized = [], G.sized_for_join

    def spy(table, max_rows):
        found = sized(table, max_rows)
        counts.append(found[1])
        return found
    monkeypatch.setattr(G, "sized_for_join", spy)
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, []), (3, None)], "row_id long, toks array<string>")
    table = spark.createDataFrame([("a", "x"), ("b", "b"), ("c", None), ("d", "y"), ("e", "e")], "tok string, out string")
    out = G.resolve_tokens(df, "toks", table, "res")
    assert {r["row_id"]: r["res"] for r in out.collect()} == {1: ["x", "b", "c", "y"], 2: [], 3: []}
    assert counts == [2]
    split = spark.createDataFrame([("a", ["x", "a"]), ("b", ["b"])], "tok string, out array<string>")
    got = G.resolve_tokens(df, "toks", split, "res")
    assert {r["row_id"]: r["res"] for r in got.collect()} == {1: ["x", "a", "b", "c", "d"], 2: [], 3: []}


def test_a_token_job_runs_the_work_before_it_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "row_id long, t string").withColumn("t", counted.asNondeterministic()("t"))
    out = cleaning._token_job(df, "t", lambda toks: toks.distinct().select("tok", F.upper("tok").alias("out")), None)
    assert {r["row_id"]: r["t"] for r in out.collect()} == {1: "A B", 2: "C", 3: ""}
    assert seen.value == 3


def test_words_meet_by_more_than_their_first_syllables(spark, monkeypatch):
    """Words alike in their first seven letters only are not compared."""
    toks, terms = ["anthereation", "anthereatoin", "anthere"], ["anthereation", "anthereousle", "anthereingly", "anthered"]
    words = spark.createDataFrame([(t,) for t in toks], "tok string")
    known = spark.createDataFrame([(t, 5) for t in terms], "term string, freq long")
    near = {("anthereation", "anthereation", 0), ("anthereatoin", "anthereation", 1), ("anthere", "anthered", 1)}
    assert {(r["tok"], r["term"], r["dist"]) for r in G.spell_candidates(words, known).collect()} == near
    monkeypatch.setattr(G, "osa", lambda *a: F.lit(1))  # every pair that is compared
    met = {(r["tok"], r["term"]) for r in G._near_pairs(words, known, 2, 7).collect()}
    assert met == {x[:2] for x in near}


def test_long_words_meet_beyond_their_keys(spark):
    """Words longer than their keys' letters, with edits before, at and after these."""
    base = "tionthereinganblewhouly"
    words = ["x" + base, base[1:], base[:11] + base[12] + base[11] + base[13:], base[:-2], base[:-2] + "yl", "xy" + base + "z"]
    got = {r["tok"]: r["dist"] for r in G.spell_candidates(spark.createDataFrame([(w,) for w in words], "tok string"),
                                                           spark.createDataFrame([(base, 5)], "term string, freq long")).collect()}
    assert got == {words[0]: 1, words[1]: 1, words[2]: 1, words[3]: 2, words[4]: 1}
