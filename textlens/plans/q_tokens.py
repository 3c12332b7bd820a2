"""Queries for the token linguistics and lexicon word lists.

The corpus is the stand-in posts after preprocess -> squeeze -> printable,
word-tokenised.  Token language, dictionaries, proper nouns and roots are
all learned from that corpus by Spark jobs, so every query's work grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import tokens as K
from ..operators import linguistics as G
from ..session import cut_lineage
from ..sources import tables as TB
from . import oracle as O
from . import stages as S
from .catalog import register

V = TB.with_views
q = O.q
LEX = L.DEFAULT
EN = "en"
MIN_COUNT = 5


# ------------------------------------------------------------ corpus ----

def corpus(spark, sf, view="tweets"):
    """Cleaned, tokenised posts, checkpointed once: every token table of a
    query derives from it without re-running the cleaning chain."""
    t = TB.TEXT_VIEWS[view](spark, sf)
    return cut_lineage(t.select("row_id", "lang", "text", K.tok_words(S.ascii_clean("text")).alias("toks")))


def models(spark, sf, c=None):
    """Corpus-trained token tables shared by the token queries."""
    c = corpus(spark, sf) if c is None else c
    lang = G.token_language_table(c, "toks")
    en_dict = G.frequency_dictionary(c.filter(F.col("lang") == EN), "toks", MIN_COUNT)
    local_dict = G.frequency_dictionary(c.filter(F.col("lang") != EN), "toks", MIN_COUNT)
    return lang, en_dict, local_dict


def distinct_tokens(c, lang=None, negate=False):
    d = c
    if lang is not None:
        cond = F.col("lang") == lang
        d = d.filter(~cond if negate else cond)
    return d.select(F.explode("toks").alias("tok")).distinct()


# SQL building blocks ------------------------------------------------------

def sql_ctes(view="tweets"):
    ct = f"ct AS (SELECT row_id, lang, text, {O.words(S.ascii_clean_sql('text'))} AS toks FROM {view})"
    tc = ("tc AS (SELECT tok, lang, count(*) AS n FROM (SELECT unnest(toks) AS tok, lang FROM ct "
          "WHERE lang IS NOT NULL) GROUP BY tok, lang)")
    tl = "token_lang AS (SELECT tok, arg_min(lang, (-n, lang)) AS lang FROM tc GROUP BY tok)"
    en = (f"en_dict AS (SELECT tok AS term, count(*) AS freq FROM (SELECT unnest(toks) AS tok FROM ct "
          f"WHERE lang = '{EN}') GROUP BY tok HAVING count(*) >= {MIN_COUNT})")
    lo = (f"local_dict AS (SELECT tok AS term, count(*) AS freq FROM (SELECT unnest(toks) AS tok FROM ct "
          f"WHERE lang <> '{EN}') GROUP BY tok HAVING count(*) >= {MIN_COUNT})")
    return [ct, tc, tl, en, lo]


def with_ctes(body, view="tweets", extra=()):
    ctes = [f"{view} AS ({TB.SQL_VIEWS[view]})"] + sql_ctes(view) + list(extra)
    return "WITH " + ", ".join(ctes) + " " + body


def sql_osa(a, b):
    """The optimal string alignment distance up to 2 (else 9): plain edits, or
    one swap whose two sides are one edit or swap apart in all.  (Distances of
    at most 1 are alike with and without the rule that no letter is edited
    twice, so the sides may use the unrestricted function.)"""
    side = (f"damerau_levenshtein(substr({a}, 1, x.i - 1), substr({b}, 1, x.j - 1)) + "
            f"damerau_levenshtein(substr({a}, x.i + 2), substr({b}, x.j + 2))")
    places = (f"list_filter(flatten(list_transform(range(1, length({a})), lambda i: [{{'i': i, 'j': i - 1}}, {{'i': i, 'j': i}}, {{'i': i, 'j': i + 1}}])), "
              f"lambda x: x.j >= 1 AND x.j < length({b}) AND substr({a}, x.i, 1) = substr({b}, x.j + 1, 1) AND substr({a}, x.i + 1, 1) = substr({b}, x.j, 1))")
    swapped = f"coalesce(list_min(list_transform({places}, lambda x: 1 + {side})), 9)"
    return (f"(CASE WHEN damerau_levenshtein({a}, {b}) > 2 THEN 9 WHEN levenshtein({a}, {b}) <= 1 THEN levenshtein({a}, {b}) "
            f"ELSE least(levenshtein({a}, {b}), {swapped}) END)")


def sql_spell_pairs(name, toks, dictionary):
    """CTE ``name``(tok, term, freq, dist) by exhaustive search."""
    return (f"{name} AS (SELECT * FROM (SELECT t.tok, d.term, d.freq, {sql_osa('t.tok', 'd.term')} AS dist FROM {toks} t, {dictionary} d "
            f"WHERE abs(length(t.tok) - length(d.term)) <= 2) WHERE dist <= 2)")


def sql_spell_best(name, toks, dictionary):
    """CTEs ending in ``name``(tok, best, dist)."""
    return (sql_spell_pairs(f"{name}_p", toks, dictionary)
            + f", {name} AS (SELECT t.tok, coalesce(b.best, t.tok) AS best, b.dist FROM {toks} t LEFT JOIN ("
            f"SELECT tok, arg_min(term, (dist, -freq, term)) AS best, min(dist) AS dist FROM {name}_p GROUP BY tok) b ON t.tok = b.tok)")


def sql_pos_tag(t="tok"):
    return (f"(CASE WHEN suffix({t}, 'ing') AND length({t}) > 4 THEN 'VBG' "
            f"WHEN suffix({t}, 'ed') AND length({t}) > 3 THEN 'VBD' "
            f"WHEN suffix({t}, 'ly') AND length({t}) > 3 THEN 'RB' "
            f"WHEN regexp_matches({t}, '(ous|ful|ive|able|ible|al|ic)$') AND length({t}) > 4 THEN 'JJ' "
            f"WHEN suffix({t}, 's') AND length({t}) > 3 AND NOT suffix({t}, 'ss') THEN 'NNS' ELSE 'NN' END)")


def sql_pos_class(tag):
    return (f"(CASE substr({tag}, 1, 1) WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'N' THEN 'n' "
            f"WHEN 'R' THEN 'r' END)")


def sql_lemma(name, toks, vocab):
    arms = []
    for cls, rules in G.MORPHY_RULES.items():
        items = ["{'i': 0, 'c': tok}"]
        for i, (suf, rep) in enumerate(rules, start=1):
            items.append(f"{{'i': {i}, 'c': CASE WHEN suffix(tok, {q(suf)}) AND length(tok) > {len(suf)} "
                         f"THEN substr(tok, 1, length(tok) - {len(suf)}) || {q(rep)} END}}")
        arms.append(f"WHEN '{cls}' THEN [{', '.join(items)}]")
    cands = f"CASE coalesce({sql_pos_class(sql_pos_tag())}, 'n') {' '.join(arms)} END"
    return (f"{name} AS (SELECT t.tok, coalesce(b.lemma, t.tok) AS lemma FROM {toks} t LEFT JOIN ("
            f"SELECT tok, arg_min(x.c, (length(x.c), x.i)) AS lemma FROM (SELECT tok, unnest({cands}) AS x FROM {toks}) "
            f"WHERE x.c IS NOT NULL AND x.c IN (SELECT term FROM {vocab}) GROUP BY tok) b ON t.tok = b.tok)")


def sql_stem(name, toks, roots):
    items, i = [], 0

    def strip(pre, suf):
        cond = ["TRUE"]
        if pre:
            cond.append(f"prefix(tok, {q(pre)})")
        if suf:
            cond.append(f"suffix(tok, {q(suf)})")
        cond.append(f"length(tok) - {len(pre) + len(suf)} >= {G.MIN_ROOT_LEN}")
        return f"CASE WHEN {' AND '.join(cond)} THEN substr(tok, {len(pre) + 1}, length(tok) - {len(pre) + len(suf)}) END"
    for pre in G.MALAY_PREFIXES:
        for suf in G.MALAY_SUFFIXES:
            items.append(f"{{'i': {i}, 'c': {strip(pre, suf)}}}")
            i += 1
    for pre in G.MALAY_PREFIXES:
        items.append(f"{{'i': {i}, 'c': {strip(pre, '')}}}")
        i += 1
    for suf in G.MALAY_SUFFIXES:
        items.append(f"{{'i': {i}, 'c': {strip('', suf)}}}")
        i += 1
    return (f"{name} AS (SELECT t.tok, coalesce(b.stem, t.tok) AS stem FROM {toks} t LEFT JOIN ("
            f"SELECT tok, arg_min(x.c, x.i) AS stem FROM (SELECT tok, unnest([{', '.join(items)}]) AS x FROM {toks}) "
            f"WHERE x.c IS NOT NULL AND x.c IN (SELECT term FROM {roots}) GROUP BY tok) b ON t.tok = b.tok)")


def sql_proper(name, view="tweets", names=None):
    names = L.NAME_WORDS if names is None else names
    pat = r"[\p{L}\p{N}_']+|[.!?]"
    return (f"{name} AS (SELECT DISTINCT tok FROM (SELECT tok FROM (SELECT lower(x.t) AS tok, count(*) AS uses, "
            f"count(*) FILTER (WHERE regexp_matches(substr(x.t, 1, 1), '^\\p{{Lu}}$')) AS caps FROM ("
            f"SELECT unnest(list_transform(r, lambda t, i: {{'t': t, 'p': CASE WHEN i = 1 THEN '.' ELSE r[i - 1] END}})) AS x "
            f"FROM (SELECT regexp_extract_all(text, {q(pat)}, 0) AS r FROM {view})) "
            f"WHERE x.p NOT IN ('.', '!', '?') AND x.t NOT IN ('.', '!', '?') GROUP BY 1) "
            f"WHERE caps >= 2 AND caps >= uses * 0.5 "
            f"UNION ALL SELECT unnest([{', '.join(q(n.lower()) for n in names)}])))")


def sql_normalize(name, toks, local_dict):
    sb = sql_spell_best(f"{name}_sb", toks, local_dict)
    body = (f"{name} AS (SELECT s.tok, {O.case_map('s.tok', L.MALAY_SHORT_FORMS, 's.best')} AS norm "
            f"FROM {name}_sb s)")
    return [sb, body]


def sql_reassemble(res, src="ct", col="toks"):
    """Per-row re-assembly of tokens mapped through ``res``(tok, out)."""
    return (f"SELECT c.row_id, coalesce(a.t, '') AS t FROM {src} c LEFT JOIN ("
            f"SELECT e.row_id, string_agg(coalesce(r.out, e.tok), ' ' ORDER BY e.pos) AS t FROM "
            f"(SELECT row_id, unnest({col}) AS tok, generate_subscripts({col}, 1) AS pos FROM {src}) e "
            f"LEFT JOIN {res} r ON e.tok = r.tok GROUP BY e.row_id) a ON c.row_id = a.row_id")


# ---------------------------------------------------------------- queries --

@register("lang_of_token", with_ctes("SELECT tok, lang FROM token_lang"))
def lang_of_token(spark, sf):
    return G.token_language_table(corpus(spark, sf), "toks")


@register("is_proper_noun", with_ctes("SELECT tok FROM proper", extra=[sql_proper("proper")]))
def is_proper_noun(spark, sf):
    return G.proper_noun_table(TB.texts(spark, sf), "text")


_EN_TOKS = f"en_toks AS (SELECT DISTINCT unnest(toks) AS tok FROM ct WHERE lang = '{EN}')"
_LO_TOKS = f"lo_toks AS (SELECT DISTINCT unnest(toks) AS tok FROM ct WHERE lang <> '{EN}')"


@register("spell_candidates", with_ctes(
    "SELECT tok, CAST(count(*) AS BIGINT) AS n_candidates, CAST(min(dist) AS BIGINT) AS best_dist FROM sp GROUP BY tok",
    extra=[_EN_TOKS, sql_spell_pairs("sp", "en_toks", "en_dict")]))
def spell_candidates(spark, sf):
    c = corpus(spark, sf)
    _, en_dict, _ = models(spark, sf, c)
    cand = G.spell_candidates(distinct_tokens(c, EN), en_dict)
    return cand.groupBy("tok").agg(F.count(F.lit(1)).alias("n_candidates"),
                                   F.min("dist").cast("long").alias("best_dist"))


@register("spell_best", with_ctes("SELECT tok, best, CAST(dist AS BIGINT) AS dist FROM sb",
                                  extra=[_EN_TOKS, sql_spell_best("sb", "en_toks", "en_dict")]))
def spell_best(spark, sf):
    c = corpus(spark, sf)
    _, en_dict, _ = models(spark, sf, c)
    return G.spell_best(distinct_tokens(c, EN), en_dict).withColumn("dist", F.col("dist").cast("long"))


@register("token_normalize", with_ctes("SELECT tok, norm FROM nm",
                                       extra=[_LO_TOKS] + sql_normalize("nm", "lo_toks", "local_dict")))
def token_normalize(spark, sf):
    c = corpus(spark, sf)
    _, _, local = models(spark, sf, c)
    return G.normalize_table(distinct_tokens(c, EN, negate=True), local)


@register("pos_to_class", with_ctes(
    f"SELECT tok, tag, {sql_pos_class('tag')} AS cls FROM (SELECT tok, {sql_pos_tag()} AS tag FROM "
    f"(SELECT DISTINCT unnest(toks) AS tok FROM ct))"))
def pos_to_class(spark, sf):
    t = corpus(spark, sf).select(F.explode("toks").alias("tok")).distinct()
    t = t.withColumn("tag", G.pos_tag(F.col("tok")))
    return t.withColumn("cls", G.pos_to_class(F.col("tag")))


@register("lemma_lookup", with_ctes("SELECT tok, lemma FROM lm", extra=[_EN_TOKS, sql_lemma("lm", "en_toks", "en_dict")]))
def lemma_lookup(spark, sf):
    c = corpus(spark, sf)
    _, en_dict, _ = models(spark, sf, c)
    return G.lemma_table(distinct_tokens(c, EN), en_dict)


@register("stem_affixes", with_ctes("SELECT tok, stem FROM st", extra=[_LO_TOKS, sql_stem("st", "lo_toks", "local_dict")]))
def stem_affixes(spark, sf):
    c = corpus(spark, sf)
    _, _, local = models(spark, sf, c)
    return G.stem_table(distinct_tokens(c, EN, negate=True), local)


def _correct_sql():
    special = LEX.special_words()
    all_toks = "all_toks AS (SELECT DISTINCT unnest(toks) AS tok FROM ct)"
    cls = (f"cls AS (SELECT a.tok, l.lang, ({O.in_list('a.tok', special)} OR p.tok IS NOT NULL) AS keep "
           f"FROM all_toks a LEFT JOIN token_lang l ON a.tok = l.tok LEFT JOIN proper p ON a.tok = p.tok)")
    en_t = f"c_en AS (SELECT tok FROM cls WHERE NOT keep AND coalesce(lang = '{EN}', FALSE))"
    lo_t = f"c_lo AS (SELECT tok FROM cls WHERE NOT keep AND NOT coalesce(lang = '{EN}', FALSE))"
    res = ("res AS (SELECT tok, tok AS out FROM cls WHERE keep UNION ALL SELECT tok, best FROM csb "
           "UNION ALL SELECT tok, CASE WHEN coalesce(norm, '') = '' THEN tok ELSE norm END FROM cnm)")
    return [all_toks, sql_proper("proper"), cls, en_t, lo_t, sql_spell_best("csb", "c_en", "en_dict")] \
        + sql_normalize("cnm", "c_lo", "local_dict") + [res]


def _correct_spark(spark, sf, c):
    lang, en_dict, local = models(spark, sf, c)
    proper = G.proper_noun_table(c, "text")
    toks = c.select(F.explode("toks").alias("tok"))
    return G.correct_table(toks, lang, proper, en_dict, local, LEX.special_words())


@register("correct_text", with_ctes(
    "SELECT row_id, t AS textspell FROM (" + sql_reassemble("res") + ")", extra=_correct_sql()))
def correct_text(spark, sf):
    c = corpus(spark, sf)
    table = _correct_spark(spark, sf, c)
    out = G.resolve_tokens(c.select("row_id", "toks"), "toks", table, "spell")
    return out.select("row_id", F.array_join("spell", " ").alias("textspell"))


def _stem_lemma_sql():
    std = LEX.standard_words()
    all_toks = "all_toks AS (SELECT DISTINCT unnest(toks) AS tok FROM ct)"
    res = (f"res AS (SELECT a.tok, CASE WHEN {O.in_list('a.tok', std)} THEN a.tok "
           f"WHEN l.lang = '{EN}' THEN lm.lemma ELSE st.stem END AS out FROM all_toks a "
           f"LEFT JOIN token_lang l ON a.tok = l.tok LEFT JOIN lm ON a.tok = lm.tok LEFT JOIN st ON a.tok = st.tok)")
    return [all_toks, sql_lemma("lm", "all_toks", "en_dict"), sql_stem("st", "all_toks", "local_dict"), res]


@register("stem_lemma_text", with_ctes(
    "SELECT row_id, t AS textfin FROM (" + sql_reassemble("res") + ")", extra=_stem_lemma_sql()))
def stem_lemma_text(spark, sf):
    c = corpus(spark, sf)
    lang, en_dict, local = models(spark, sf, c)
    toks = c.select(F.explode("toks").alias("tok"))
    table = G.stem_lemma_table(toks, lang, en_dict, local, LEX.standard_words())
    out = G.resolve_tokens(c.select("row_id", "toks"), "toks", table, "fin")
    return out.select("row_id", F.array_join("fin", " ").alias("textfin"))


def _split_sql():
    special = LEX.special_words()
    res = (f"res AS (SELECT x.tok, CASE WHEN NOT {O.in_list('x.tok', special)} AND coalesce(l.lang <> '{EN}', TRUE) "
           f"AND length(x.tok) > 1 THEN 'x ' || substr(x.tok, 2) ELSE x.tok END AS out FROM "
           f"(SELECT DISTINCT unnest(toks) AS tok FROM nct) x LEFT JOIN token_lang l ON x.tok = l.tok "
           f"WHERE prefix(x.tok, 'x'))")
    nct = f"nct AS (SELECT row_id, {O.words(S.ascii_clean_sql('text'))} AS toks FROM noisy)"
    return [f"noisy AS ({TB.SQL_VIEWS['noisy']})", nct, res]


@register("tok_split_prefix", with_ctes(
    "SELECT row_id, t FROM (" + sql_reassemble("res", "nct") + ")", extra=_split_sql()))
def tok_split_prefix(spark, sf):
    """split_x() on posts with x-prefixed short forms; token language is
    learned from the unprefixed corpus."""
    c = corpus(spark, sf)
    lang = G.token_language_table(c, "toks")
    n = cut_lineage(TB.noisy(spark, sf).select("row_id", K.tok_words(S.ascii_clean("text")).alias("toks")))
    table = G.split_prefix_table(n.select(F.explode("toks").alias("tok")), lang, LEX.special_words())
    out = G.resolve_tokens(n, "toks", table, "split")
    return out.select("row_id", F.array_join("split", " ").alias("t"))


def _lang_model_sql():
    """The model and its scores: what every token sums up to in each language."""
    grams = ("flatten([" + ", ".join(f"list_transform(range(1, greatest(length(w) - {n - 1}, 1) + 1), lambda i: substr(w, i, {n}))"
                                     for n in range(1, G.GRAM + 1)) + "])")
    return [f"lg AS (SELECT tok, lang, {grams} AS g FROM (SELECT tok, lang, '<' || tok || '>' AS w FROM token_lang))",
            "seen AS (SELECT gram, lang, count(*) AS n FROM (SELECT lang, unnest(g) AS gram FROM lg) GROUP BY gram, lang)",
            "known AS (SELECT count(DISTINCT gram) AS v FROM seen)",
            "floors AS (SELECT lang, -ln(sum(n) + any_value(v)) AS floor FROM seen, known GROUP BY lang)",
            "langs AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM token_lang)) AS prior FROM token_lang GROUP BY lang)",
            "met AS (SELECT e.tok, s.lang, sum(ln(s.n + 1)) AS more FROM (SELECT tok, unnest(g) AS gram FROM lg) e JOIN seen s ON e.gram = s.gram "
            "GROUP BY e.tok, s.lang)",
            "scored AS (SELECT t.tok, f.lang, round(p.prior + len(t.g) * f.floor + coalesce(m.more, 0), 6) AS score FROM lg t, floors f "
            "JOIN langs p ON p.lang = f.lang LEFT JOIN met m ON m.tok = t.tok AND m.lang = f.lang)"]


@register("lang_model", with_ctes(
    "SELECT t.tok, t.lang, b.lang_pred FROM token_lang t JOIN (SELECT tok, arg_min(lang, (-score, lang)) AS lang_pred FROM scored "
    "GROUP BY tok) b ON t.tok = b.tok", extra=_lang_model_sql()))
def lang_model(spark, sf):
    """A character n-gram model learned from the corpus token-language table;
    its language for every distinct token by summed log-likelihoods."""
    table = cut_lineage(G.token_language_table(corpus(spark, sf), "toks"))
    return table.join(G.language_of(table, G.language_model(table)), "tok").select("tok", "lang", "lang_pred")
