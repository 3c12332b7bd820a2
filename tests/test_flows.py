"""Each cleaning flow runs to the end on whole tables, and the periods cover them."""

import pytest
from pyspark.sql import functions as F

from textlens.operators import relational as R
from textlens.plans import catalog, q_flows
from textlens.sources import tables as TB

from .conftest import SF_SMALL


@pytest.mark.parametrize("key", ["clean_train_english", "clean_train_local", "clean_test_english", "clean_test_local"])
def test_flow_gives_clean_rows(spark, key):
    rows = catalog.queries()[key](spark, SF_SMALL).collect()
    assert rows and all(r["textfin"] is not None for r in rows)
    ids = [r["row_id"] for r in rows]
    assert len(ids) == len(set(ids))
    for r in rows:
        assert r["textclean"] == r["textclean"].strip() and "http" not in r["textclean"]


def test_periods_cover_the_table(spark):
    whole = TB.texts(spark, SF_SMALL)
    assert q_flows._periods(spark, SF_SMALL).count() == whole.count()


def test_author_filter_meets_names_that_do_not_parse(spark):
    """A condition on the author column must not run on the author list."""
    df = spark.createDataFrame([("src12",), ("src3",), ("official",), (None,)], "username string")
    num = F.regexp_extract("username", r"(\d+)$", 1)
    some = df.filter(num.rlike(r"^\d") & (F.when(num == "", F.lit(None)).otherwise(num).cast("int") >= 10))
    assert [r[0] for r in R.filter_exclude_authors(some, ["official", "press"]).collect()] == ["src12"]
    assert {r[0] for r in R.filter_exclude_authors(df, ["official"]).collect()} == {"src12", "src3", None}
    table = spark.createDataFrame([("official",)], "username string")
    assert {r[0] for r in R.filter_exclude_authors(df, table).collect()} == {"src12", "src3", None}
