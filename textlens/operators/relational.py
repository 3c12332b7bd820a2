"""Filters, duplicates, profiles, cross tables, unions and joins.

Table functions take and return ``DataFrame``s and stay lazy.  Design notes
for scale:

* filters on plain columns are written as column predicates so Catalyst
  pushes them into the parquet scan;
* duplicate removal and every count are ``groupBy`` aggregations, so Spark's
  partial (map-side) aggregation collapses a hot key (one text copied into a
  third of all rows) before the shuffle -- no window over a hot partition;
* joins against lexicons or per-token tables are plain equi-joins; AQE turns
  them into broadcasts only when the measured side is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions.patterns import escape
from ..functions.tokens import tok_count

# ------------------------------------------------------------ projections --


def project_columns(df: DataFrame, cols, key: str = "row_id") -> DataFrame:
    cols = [c for c in cols if c != key]
    return df.select(key, *cols)


def cast_text(df: DataFrame, col: str = "text", parity: bool = False) -> DataFrame:
    c = F.col(col).cast("string")
    if parity:  # missing text becomes the word 'nan'
        c = F.coalesce(c, F.lit("nan"))
    return df.withColumn(col, c)


def parse_timestamp(c) -> Column:
    return F.try_to_timestamp(c if isinstance(c, Column) else F.col(c))


# ---------------------------------------------------------------- filters --

#: Longer author lists are joined as a table.
LITERAL_AUTHORS = 1_000


def filter_period(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Half-open period ``lo < ts <= hi`` (pushes down to the scan)."""
    return df.filter((F.col(col) > F.lit(lo)) & (F.col(col) <= F.lit(hi)))


def filter_language(df: DataFrame, lang: str, col: str = "lang") -> DataFrame:
    return df.filter(F.col(col) == lang)


def filter_exclude_authors(df: DataFrame, authors=None, col: str = "username") -> DataFrame:
    """Drop posts by listed authors; a missing author is kept.  ``authors`` is
    a list of at most LITERAL_AUTHORS names, which stays a condition on the
    column, or a table with the column ``col``, which Spark broadcasts by its
    size or shuffles.  (Joining a short list would let Spark infer other
    conditions on the author column and run them on the list.)"""
    authors = L.EXCLUDED_AUTHORS if authors is None else authors
    if not isinstance(authors, DataFrame):
        if len(authors) <= LITERAL_AUTHORS:
            return df.filter(~F.coalesce(F.col(col).isin(list(authors)), F.lit(False)))
        authors = df.sparkSession.createDataFrame([(a,) for a in authors], f"{col} string")
    return df.join(authors.select(col), col, "left_anti").select(*df.columns)


def filter_include_terms(df: DataFrame, col: str, terms) -> DataFrame:
    """Keep rows whose text holds any term as a substring (case-sensitive)."""
    return df.filter(F.col(col).rlike("|".join(escape(t) for t in terms)))


def filter_exclude_terms(df: DataFrame, col: str, terms) -> DataFrame:
    """Drop rows whose text holds any term as a substring (NULL text drops)."""
    return df.filter(~F.col(col).rlike("|".join(escape(t) for t in terms)))


def filter_min_tokens(df: DataFrame, col: str, n: int = 4) -> DataFrame:
    return df.filter(tok_count(col) >= n)


def filter_not_label(df: DataFrame, col: str, value: str) -> DataFrame:
    """``~(s == value)``: rows with a missing label are kept."""
    return df.filter(~F.col(col).eqNullSafe(value))


def filter_event_rows(df: DataFrame, col: str = "target", value: str = "yes") -> DataFrame:
    return df.filter(F.col(col) == value)


def head_n(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """First n rows in row order (a top-k, not a global sort)."""
    return df.orderBy(order).limit(n)


def sample_n(df: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """n rows by a seeded hash order: reproducible, and a top-k at scale."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(h, key).limit(n)


# ------------------------------------------------------------- duplicates --


def dedupe_keep_last(df: DataFrame, key: str, order=("row_id",)) -> DataFrame:
    """One row per ``key`` value: the last in row order.

    ``max_by(struct(*), order)`` aggregates partially on the map side, so a
    key copied into a third of the table is reduced inside each task before
    the shuffle (a window over ``key`` would send all copies to one task).
    """
    order = [order] if isinstance(order, str) else list(order)
    cols = df.columns
    ordkey = F.struct(*[F.col(o) for o in order]) if len(order) > 1 else F.col(order[0])
    agg = (df.groupBy(key)
           .agg(F.max_by(F.struct(*[F.col(c) for c in cols if c != key]), ordkey).alias("_r")))
    return agg.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in cols])


# ---------------------------------------------------------- aggregations --


def group_size(df: DataFrame, keys) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """Contingency table; pivot values are given so no extra job runs."""
    d = df.dropna(subset=[row, col])
    out = d.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return out.select(row, *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values])


def describe_categorical(df: DataFrame, cols) -> DataFrame:
    """count, unique, top, freq per column, in one pass over the table."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in cols]))
    vc = (df.select(pairs.alias("p")).select("p.column", "p.value")
          .filter(F.col("value").isNotNull())
          .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    return vc.groupBy("column").agg(
        F.sum("n").cast("long").alias("count"),
        F.count(F.lit(1)).cast("long").alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("nn"), F.col("value"))).alias("top"),
        F.max("n").cast("long").alias("freq"))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, one pass, one row per column."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return sums.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column, n_missing)")


def table_profile(df: DataFrame) -> DataFrame:
    """Shape and types: one row per column with the row count."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    parts = ", ".join(f"{i}, '{f.name}', '{f.dataType.simpleString()}'"
                      for i, f in enumerate(df.schema.fields))
    return n.selectExpr("n_rows", f"stack({len(df.schema.fields)}, {parts}) AS (position, column, dtype)") \
        .select(F.col("position").cast("long"), "column", "dtype", "n_rows")


def class_counts(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


def vocab_size(df: DataFrame, tokens: str, approx: bool = False) -> DataFrame:
    t = df.select(F.explode(tokens).alias("tok"))
    if approx:
        return t.agg(F.approx_count_distinct("tok").alias("n_terms"))
    return t.agg(F.count_distinct("tok").alias("n_terms"))


def distinct_tokens(lex: DataFrame, col: str = "term") -> DataFrame:
    """Unique single words of a lexicon's phrases."""
    return (lex.select(F.explode(F.split(F.col(col), r"\s+")).alias("token"))
            .filter(F.col("token") != "").distinct())


# ------------------------------------------------------------- set ops --


def union_periods(frames) -> DataFrame:
    """Stack periods in the given order; ``batch_no`` + ``row_id`` is the
    row order used later by keep-last duplicate removal."""
    tagged = [f.withColumn("batch_no", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def lexicon_union(*lexicons: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), lexicons).distinct()


def lexicon_except(words: DataFrame, keep: DataFrame, col: str = "term") -> DataFrame:
    return words.select(col).distinct().join(keep.select(col), col, "left_anti")


# ----------------------------------------------------------------- joins --


def join_rows_by_id(features: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    return features.join(rows, key, "inner")


def explode_tokens(df: DataFrame, tokens: str, key: str = "row_id") -> DataFrame:
    """(key, pos, tok) rows; pos keeps token order for re-assembly."""
    return df.select(key, F.posexplode(tokens).alias("pos", "tok"))


def join_token_lexicon(tok: DataFrame, lex: DataFrame, how: str = "left",
                       on: str = "tok") -> DataFrame:
    return tok.join(lex, on, how)
