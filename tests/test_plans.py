"""Plan-shape regression tests: pushdown, pruning, broadcast join-back."""

from .conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_filter_pushed_to_scan(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["filter_period"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in p


def test_columns_pruned_at_scan(spark):
    from pyspark.sql import functions as F

    from textlens.sources import tables as TB
    df = TB.table(spark, SF_SMALL, "documents").select("doc_id", F.upper("lang"))
    p = plan(df)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_token_join_back_is_broadcast(spark):
    from textlens.operators import linguistics as G
    df = spark.createDataFrame([(1, ["a", "b"])], "row_id long, toks array<string>")
    table = spark.createDataFrame([("a", "x")], "tok string, out string")
    out = G.resolve_tokens(df, "toks", table, "o")
    out.collect()
    assert "BroadcastHashJoin" in plan(out) or "BroadcastExchange" in plan(out)


def scans(df):
    """The scan lines of a plan, all of adaptive execution's plans included."""
    return [x for x in df._jdf.queryExecution().toString().split("\n") if "FileScan" in x or "PushedFilters" in x or "ReadSchema" in x]


def test_views_push_filters_and_prune_columns(spark):
    import __spark_entry__ as E
    q = E.queries()
    p = "\n".join(scans(q["filter_language"](spark, SF_SMALL)))
    assert "EqualTo(lang,en)" in p
    assert "text" not in p.split("ReadSchema: ")[1].split("\n")[0]
    for key in ("group_size", "label_encode"):
        p = "\n".join(scans(q[key](spark, SF_SMALL)))
        assert "ReadSchema" in p and "text:string" not in p, key


def test_views_start_no_job(spark):
    from textlens.sources import tables as TB
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("views", "")
    for view in (TB.tweets, TB.texts, TB.labelled, TB.noisy):
        view(spark, SF_SMALL)
    assert list(tracker.getJobIdsForGroup("views")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_spread_keeps_text_work_above_the_repartition(spark):
    from pyspark.sql import functions as F
    from textlens.sources import tables as TB
    t = TB.texts(spark, SF_SMALL).filter(F.upper("text").contains("X"))
    lines = t._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "RepartitionByExpression" in x)
    assert any("Contains(upper" in x or "upper(text" in x for x in lines[:at])
    assert t.count() == TB.tweets(spark, SF_SMALL).filter(F.upper("text").contains("X")).count()
