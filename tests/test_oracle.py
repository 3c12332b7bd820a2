"""Catalog queries against their DuckDB oracle at sf0.001 (a quick subset;
tools/oracle_check.py runs all of them)."""

import duckdb
import pytest

from tools.oracle_check import TABLES, digest

from .conftest import SF_SMALL

KEYS = ["clean_dedupe_by_lang", "clean_preprocess", "txt_dict_replace", "tok_stopwords", "txt_laughter",
        "filter_include_terms", "crosstab", "describe_categorical", "null_counts", "lex_pairs",
        "lang_of_token", "spell_best", "phrase_fit", "bag_of_words", "coherence_cv", "doc_mean_vector",
        "stratified_folds", "split_train_test", "roc_auc", "roc_curve", "tfidf", "phrase_apply", "filter_exclude_authors",
        "classification_report", "count_terms", "filter_language"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    import __spark_entry__ as E
    df = E.queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows) == digest(dcols, drows)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    rows = {r["lang"]: r["n"] for r in out.collect()}
    assert out.columns == ["lang", "n"] and set(rows) == {"en", "de", "fr", "es"}
    assert 0 < sum(rows.values()) <= spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
