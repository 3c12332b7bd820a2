"""Reusable cleaning stages (Spark columns and their DuckDB SQL twins).

A stage is a pure column expression; chaining stages never adds a shuffle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T
from ..functions import tokens as K
from . import oracle as O


def basic(c, lex: L.Lexicons = L.DEFAULT):
    """After preprocess+dedupe: squeeze runs, printable, slang dict, domain map."""
    c = T.txt_squeeze_runs(c)
    c = T.txt_printable(c)
    c = T.txt_dict_replace(c, lex.replacements)
    return K.tok_map_domain(c)


def basic_sql(e: str, lex: L.Lexicons = L.DEFAULT) -> str:
    e = O.squeeze_runs(e)
    e = O.printable(e)
    e = O.dict_replace(e, lex.replacements, "bi")
    return O.map_domain(e)


def ascii_clean(c):
    """preprocess -> squeeze -> printable (the ASCII text later steps see)."""
    return T.txt_printable(T.txt_squeeze_runs(T.clean_preprocess(c)))


def ascii_clean_sql(e: str) -> str:
    return O.printable(O.squeeze_runs(O.clean_preprocess(e)))


def textclean(df, col="text", out="textclean"):
    return df.withColumn(out, T.clean_preprocess(F.col(col)))


def laugh_clean(c):
    """ASCII-cleaned text with laughter standardised."""
    return T.txt_laughter(ascii_clean(c))


def laugh_clean_sql(e: str) -> str:
    return O.laughter(ascii_clean_sql(e))
