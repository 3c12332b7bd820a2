"""DuckDB SQL expression builders for the correctness oracle.

These produce SQL text for DuckDB (RE2 regexes, ``lambda x:`` list
functions).  They mirror the Spark column functions step by step so each
registered query has an independent SQL statement computing the same value.
"""

from __future__ import annotations

from .. import lexicons as L
from ..functions.patterns import NOT_WS_RUN, TOKEN, W, WS, WS_RUN, escape, word_alternation


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(e: str, pat: str, repl: str) -> str:
    return f"regexp_replace({e}, {q(pat)}, {q(repl)}, 'g')"


def join(lst: str, sep: str = " ") -> str:
    return f"array_to_string({lst}, {q(sep)})"


def tokens(e: str) -> str:
    return f"regexp_extract_all({e}, {q(TOKEN)}, 0)"


def regex_tokens(e: str) -> str:
    return join(tokens(e))


def case_map(e: str, pairs, default: str | None = None) -> str:
    pairs = L.dedupe_pairs(pairs)
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs)
    return f"(CASE {e} {arms} ELSE {default if default is not None else e} END)"


def in_list(e: str, words) -> str:
    words = list(dict.fromkeys(words))
    if not words:
        return "FALSE"
    return f"({e} IN ({', '.join(q(w) for w in words)}))"


def bind(e: str, body: str, var: str) -> str:
    """Evaluate ``e`` once and name it ``var`` inside ``body`` (DuckDB has no
    LET; a one-element list_transform binds without a correlated subquery)."""
    return f"list_transform([{e}], lambda {var}: {body})[1]"


def dict_replace(e: str, pairs, var: str = "i") -> str:
    pairs = L.dedupe_pairs(pairs)
    if not pairs:
        return e
    pat = word_alternation([k for k, _ in pairs])
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs)
    s = f"s_{var}"
    body = (f"CASE WHEN {s} IS NULL THEN NULL ELSE array_to_string(list_transform(list_zip("
            f"string_split_regex({s}, {q(pat)}), regexp_extract_all({s}, {q(pat)}, 0)), "
            f"lambda p_{var}: p_{var}[1] || coalesce(CASE p_{var}[2] {arms} END, '')), '') END")
    return bind(e, body, s)


def clean_preprocess(e: str, contractions=True, strip_rt=False) -> str:
    e = f"lower({e})"
    e = f"replace({e}, '{{html}}', '')"
    e = rx(e, r"<[^\n]*?>", "")
    if strip_rt:
        e = rx(e, rf"^RT[{WS}]+", "")
    e = rx(e, rf"@{NOT_WS_RUN}", "")
    e = rx(e, rf"#{NOT_WS_RUN}", "")
    e = rx(e, rf"http{NOT_WS_RUN}", "")
    e = rx(e, rf"pic[^\n]twitter[^\n]com[^{WS}]+", "")
    e = rx(e, rf"twitter[^\n]com[^{WS}]+", "")
    e = f"replace({e}, '½', '.5')"
    e = rx(e, r"[0-9]+", "")
    if contractions:
        e = dict_replace(e, L.CONTRACTIONS, "ci")
    e = rx(e, rf"([{W}]+)'s", r"\1")
    e = rx(e, rf"[^{W}{WS}]", " ")
    return regex_tokens(e)


def squeeze_runs(e: str) -> str:
    """Drop a character when it equals the two before it (runs of 3+ -> 2),
    newlines excepted; characters are split once so access is O(1)."""
    body = ("array_to_string(list_filter(cs, lambda ch, i: NOT (i >= 3 AND ch = cs[i - 1] "
            "AND ch = cs[i - 2] AND ch <> chr(10))), '')")
    return bind(f"string_split({e}, '')", body, "cs")


def printable(e: str) -> str:
    return rx(e, r"[^\x20-\x7E\t\n\r\x0B\x0C]", "")


def laughter(e: str) -> str:
    for p in L.LAUGH_PATTERNS:  # the patterns as declared: RE2 is linear by itself
        e = rx(e, p, "laugh")
    return regex_tokens(e)


def split_ws(e: str) -> str:
    return f"list_filter(string_split_regex({e}, {q(WS_RUN)}), lambda x: x <> '')"


def words(e: str) -> str:
    """tok_words: whitespace split plus the six fixed splits."""
    return (f"flatten(list_transform({split_ws(e)}, lambda t: CASE WHEN lower(t) IN "
            f"({', '.join(q(w) for w in L.NLTK_SPLIT_WORDS)}) "
            f"THEN [substr(t, 1, 3), substr(t, 4)] ELSE [t] END))")


def remove(lst: str, ws) -> str:
    ws = list(dict.fromkeys(ws))
    if not ws:
        return lst
    return f"list_filter({lst}, lambda x: NOT {in_list('x', ws)})"


def stopwords(e: str, lex=L.DEFAULT) -> str:
    return join(remove(words(e), lex.stopwords()))


def map_domain(e: str) -> str:
    return join(f"list_transform({tokens(e)}, lambda t: {case_map('t', L.domain_pairs())})")


def mask_terms(e: str, terms=None) -> str:
    terms = L.TOPIC_MASK_TOKENS if terms is None else terms
    return join(f"list_transform({tokens(e)}, lambda t: CASE WHEN {in_list('t', terms)} THEN '' ELSE t END)")


def mask_phrases(e: str, phrases=None) -> str:
    phrases = L.STATION_NAMES if phrases is None else phrases
    if phrases:
        e = rx(e, word_alternation(phrases), "")
    return regex_tokens(e)


def include(e: str, terms) -> str:
    return f"regexp_matches({e}, {q('|'.join(escape(t) for t in terms))})"
