"""Token linguistics as Spark jobs: language, proper nouns, spelling,
normalisation, lemmas, stems, and the per-token rewrites of the cleaning
pipelines.

The reference resolves every token occurrence with a per-token library call
inside a row loop.  Here every operator follows one contract:

    explode -> distinct tokens -> resolve each distinct token once (joins)
    -> join back -> re-assemble each row's tokens in position order

``resolve_tokens`` does the join back.  The per-token table is checkpointed
to the shared checkpoint folder and counted; it is broadcast only under a
proven row bound, otherwise the exploded side is shuffled on the token and
AQE splits hot tokens.  Vocabulary counts are ``groupBy`` aggregations, so a
token holding a third of all occurrences is combined map-side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..session import cut_lineage

BROADCAST_MAX_TOKENS = 2_000_000

# ============================================================================
# FIXED VALUES: WordNet detachment rules (public WordNet/NLTK morphology)
# ============================================================================
MORPHY_RULES = {
    "n": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
          ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"),
          ("ed", ""), ("ing", "e"), ("ing", "")],
    "a": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
    "r": [],
}

# Our own Malay affix rules (prefixes longest first, then suffixes).
MALAY_PREFIXES = ["meng", "meny", "mem", "men", "me", "ber", "be", "di", "ter",
                  "te", "peng", "peny", "pem", "pen", "pe", "ke", "se"]
MALAY_SUFFIXES = ["kan", "lah", "kah", "nya", "an", "i"]
MIN_ROOT_LEN = 3


# ---------------------------------------------------------------- basics --

def explode_tokens(df: DataFrame, tokens: str, key: str = "row_id", extra=()) -> DataFrame:
    return df.select(key, *extra, F.posexplode(tokens).alias("pos", "tok"))


def token_counts(df: DataFrame, tokens: str, extra=()) -> DataFrame:
    """(tok, *extra, n): occurrences per distinct token (partial aggregation)."""
    ex = df.select(*extra, F.explode(tokens).alias("tok"))
    return ex.groupBy("tok", *extra).agg(F.count(F.lit(1)).alias("n"))


def sized_for_join(table: DataFrame, max_rows: int = BROADCAST_MAX_TOKENS):
    """Checkpoint a per-token table and broadcast it only if its measured
    row count is within ``max_rows``."""
    table = cut_lineage(table)
    n = table.count()
    return (F.broadcast(table) if n <= max_rows else table), n


def resolve_tokens(df: DataFrame, tokens: str, table: DataFrame, out: str,
                   key: str = "row_id", value: str = "out", max_rows: int = BROADCAST_MAX_TOKENS) -> DataFrame:
    """Replace each token of ``df[tokens]`` by ``table[value]`` (keyed by
    ``tok``); tokens missing from the table stay.  ``value`` may be a string
    or an array of strings (a token split in several).  Rows keep their other
    columns; ``out`` is ARRAY<STRING>.  ``df`` is read twice, so give it cut off
    from work that should run once."""
    vtype = dict(table.dtypes)[value]
    is_array = vtype.startswith("array")
    # a token that stays as it is needs no row, so the table is shorter and oftener within the bound
    stays = F.col(value) == (F.array("tok") if is_array else F.col("tok"))
    t, _ = sized_for_join(table.where(~stays).select("tok", F.col(value).alias("_v")), max_rows)
    base = df.select(key, tokens).repartition(key)
    ex = base.select(key, F.posexplode(tokens).alias("pos", "tok"))
    j = ex.join(t, "tok", "left")
    v = F.coalesce(F.col("_v"), F.array("tok")) if is_array else F.coalesce(F.col("_v"), F.col("tok"))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", v.alias("v")))).alias("_l"))
    if is_array:
        res = g.select(key, F.flatten(F.transform("_l", lambda x: x["v"])).alias(out))
    else:
        res = g.select(key, F.transform("_l", lambda x: x["v"]).alias(out))
    joined = df.join(res, key, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>")))


# ------------------------------------------------------------- language --

def token_language_table(df: DataFrame, tokens: str, lang: str = "lang") -> DataFrame:
    """(tok, lang): the language whose documents use the token most; ties go
    to the smaller language name.  Trained on the corpus itself, in place of
    a pretrained per-token detector."""
    c = token_counts(df.filter(F.col(lang).isNotNull()), tokens, extra=(lang,))
    return c.groupBy("tok").agg(F.min_by(lang, F.struct((-F.col("n")).alias("nn"), F.col(lang))).alias("lang"))


# ----------------------------------------------------------- dictionaries --

def frequency_dictionary(df: DataFrame, tokens: str, min_count: int = 5) -> DataFrame:
    """(term, freq): corpus word frequencies, kept from ``min_count``."""
    c = token_counts(df, tokens)
    return c.filter(F.col("n") >= min_count).select(F.col("tok").alias("term"), F.col("n").alias("freq"))


# ---------------------------------------------------------- proper nouns --

def proper_noun_table(df: DataFrame, text: str, names=None, min_uses: int = 2,
                      min_share: float = 0.5) -> DataFrame:
    """(tok): lower-case forms used as proper nouns.

    Corpus evidence: among uses that are not sentence-initial, at least
    ``min_share`` are capitalised and at least ``min_uses`` are; plus a names
    lexicon."""
    names = L.NAME_WORDS if names is None else names
    raw = F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}_']+|[.!?]"), F.lit(0))
    pairs = F.zip_with(raw, F.concat(F.array(F.lit(".")), raw),
                       lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    ex = df.select(F.explode(pairs).alias("x")).select("x.t", "x.p")
    mid = ex.filter(~F.col("p").isin(".", "!", "?") & ~F.col("t").isin(".", "!", "?"))
    cap = F.substring("t", 1, 1).rlike(r"^\p{Lu}$")
    agg = (mid.groupBy(F.lower("t").alias("tok"))
           .agg(F.count(F.lit(1)).alias("uses"), F.count(F.when(cap, 1)).alias("caps")))
    ev = agg.filter((F.col("caps") >= min_uses) & (F.col("caps") >= F.col("uses") * min_share)).select("tok")
    lex = df.sparkSession.createDataFrame([(n.lower(),) for n in names], "tok string")
    return ev.unionByName(lex).distinct()


# --------------------------------------------------------------- spelling --

def deletes(word: Column, max_dist: int = 2, prefix: int = 7) -> Column:
    """All strings made by deleting up to ``max_dist`` (1 or 2) characters of
    the first ``prefix`` characters, the prefix itself included."""
    p = F.substring(word, 1, prefix)
    n = F.greatest(F.length(p), F.lit(1))
    # written out place by place: a lambda over places would run interpreted

    def without(*places):
        cuts = [0, *places, prefix + 1]
        kept = [F.substring(p, a + 1, b - a - 1) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
        return F.when(n >= places[-1], F.concat(*kept)).otherwise(p)
    out = [p] + [without(i) for i in range(1, prefix + 1)]
    if max_dist >= 2:
        out += [without(i, j) for i in range(1, prefix + 1) for j in range(i + 1, prefix + 1)]
    return F.when(word.isNotNull(), F.array_distinct(F.array(*out)))


def swaps_apart(a: Column, b: Column, more: int) -> Column:
    """Whether two words meet by swapping two neighbouring letters and at most
    ``more`` (0 or 1) further edits elsewhere, one of which may be a swap.

    For a swap at place i of ``a`` that stands at i, i - 1 or i + 1 of ``b``,
    what is before and what is after it must be ``more`` apart in all."""
    near = F.length(a) - F.length(b)
    if more == 0:
        def one(i):
            return ((F.substring(a, i, 1) == F.substring(b, i + 1, 1)) & (F.substring(a, i + 1, 1) == F.substring(b, i, 1))
                    & (F.substring(a, 1, i - 1) == F.substring(b, 1, i - 1)) & (F.substring(a, i + 2, LONGEST) == F.substring(b, i + 2, LONGEST)))
        return (near == 0) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), one)

    def at(i, j):
        before = F.substring(a, 1, i - 1), F.substring(b, 1, j - 1)
        after = F.substring(a, i + 2, LONGEST), F.substring(b, j + 2, LONGEST)
        rest = ((before[0] == before[1]) & ((F.levenshtein(*after, 1) >= 0) | swaps_apart(*after, 0))) | (
            (after[0] == after[1]) & ((F.levenshtein(*before, 1) >= 0) | swaps_apart(*before, 0)))
        turned = (F.substring(a, i, 1) == F.substring(b, j + 1, 1)) & (F.substring(a, i + 1, 1) == F.substring(b, j, 1))
        return (j >= 1) & (j < F.length(b)) & F.when(turned, rest).otherwise(False)

    return (F.abs(near) <= 1) & (F.length(a) > 1) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: at(i, i) | at(i, i - 1) | at(i, i + 1))


#: Longer than any word.
LONGEST = 1 << 20


def letters(word: Column) -> Column:
    """A word's letters in alphabetical order."""
    return F.array_join(F.sort_array(F.split(word, "")), "")


def osa(a: Column, b: Column, a_letters: Column | None = None, b_letters: Column | None = None, plain: Column | None = None) -> Column:
    """The optimal string alignment distance of two words if it is at most 2,
    else NULL: insertions, deletions, substitutions and swaps of neighbouring
    letters cost 1, and no letter is edited twice.

    A swap costs two plain edits, so words beyond four plain edits are out, and
    only words two to four plain edits apart are looked at for swaps.  A swap
    leaves a word's ``letters`` as they are and an edit changes them by two edits
    at most, so most words are out by their letters: two swaps (four plain
    edits), or one swap alone, need the same letters."""
    al, bl = (letters(a) if a_letters is None else a_letters), (letters(b) if b_letters is None else b_letters)
    plain = F.levenshtein(a, b, 4) if plain is None else plain
    return (F.when(plain < 0, F.lit(None)).when(plain <= 1, plain)
            .when(plain == 2, F.when((al == bl) & swaps_apart(a, b, 0), F.lit(1)).otherwise(F.lit(2)))
            .when(((plain == 3) & (F.levenshtein(al, bl, 2) >= 0)) | (al == bl), F.when(swaps_apart(a, b, 1), F.lit(2))))


def spell_candidates(tokens: DataFrame, dictionary: DataFrame, max_dist: int = 2,
                     prefix: int = 7) -> DataFrame:
    """(tok, term, dist, freq): dictionary terms within ``max_dist`` (1 or 2)
    edits, a swap of neighbouring letters being one.

    Symmetric deletes: both sides expand to their delete keys (at most
    1 + 7 + 21 per word), an equi-join on the key proposes pairs (pruned by
    length difference), and the optimal string alignment distance confirms
    them before equal pairs are dropped.  Only distinct tokens enter.  Keys of at most
    ``SHORT_KEY`` letters, which many words share, are split by the length of
    the other side's word: a key carries the lengths that may meet it."""
    pairs = _near_pairs(tokens.select("tok").distinct(), dictionary, max_dist, prefix)
    return pairs.distinct()


def _near_pairs(tokens: DataFrame, dictionary: DataFrame, max_dist: int, prefix: int) -> DataFrame:
    """The confirmed pairs of distinct tokens, once for each key they share.

    Words made of the same few syllables share most of their short prefixes, and
    confirming a pair costs more than a key, so keys are made from ``KEY_LETTERS``
    letters where ``prefix`` is less: more keys, far fewer pairs, the same result.
    Keys travel as hashes; words that meet by a hash alone are not confirmed.

    Confirming costs far more than the keys' bytes show, so the keys are dealt
    into a set number of tasks, which adaptive execution does not merge."""
    sc = tokens.sparkSession.sparkContext
    parts = max(TASKS_PER_CORE * sc.defaultParallelism, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    prefix = max(prefix, KEY_LETTERS)
    tokens, dictionary = (t.repartition(sc.defaultParallelism, F.xxhash64(c)) for t, c in ((tokens, "tok"), (dictionary, "term")))
    # the letters before the keys, so once for a word
    tk = tokens.select("tok", letters(F.col("tok")).alias("tl")).select("tok", "tl", F.explode(deletes(F.col("tok"), max_dist, prefix)).alias("k"))
    dk = dictionary.select("term", "freq", letters(F.col("term")).alias("dl"))
    dk = dk.select("term", "freq", "dl", F.explode(deletes(F.col("term"), max_dist, prefix)).alias("k"))
    # the band: of a short key the length of the token, to which a term offers every length within reach
    short = F.length("k") <= SHORT_KEY
    tk = tk.select("tok", "tl", F.xxhash64("k", F.when(short, F.length("tok")).otherwise(-1)).alias("key"))
    reach = F.sequence(F.greatest(F.length("term") - max_dist, F.lit(0)), F.length("term") + max_dist)
    dk = dk.select("term", "freq", "dl", "k", F.explode(F.when(short, reach).otherwise(F.array(F.lit(-1)))).alias("band"))
    dk = dk.select("term", "freq", "dl", F.xxhash64("k", "band").alias("key"))
    tk, dk = tk.repartition(parts, "key"), dk.repartition(parts, "key")
    cond = (tk["key"] == dk["key"]) & (F.abs(F.length(tk["tok"]) - F.length(dk["term"])) <= max_dist)
    # each step a column of its own, and the last one chosen by ``explode``: a filter would move below them and work them out again
    met = tk.join(dk, cond).select("tok", "term", "freq", "tl", "dl", F.levenshtein("tok", "term", 2 * max_dist).alias("plain"))
    dist = osa(F.col("tok"), F.col("term"), F.col("tl"), F.col("dl"), F.col("plain"))
    return (met.select("tok", "term", "freq", dist.alias("dist"))
            .select("tok", "term", "freq", F.explode(F.when(F.col("dist") <= max_dist, F.array("dist"))).alias("dist")))


#: Letters that delete keys are made from at least.
KEY_LETTERS = 12
#: Delete keys of at most so many letters are split by length.
SHORT_KEY = 3
#: Tasks for each core that compare words.
TASKS_PER_CORE = 4


def spell_best(tokens: DataFrame, dictionary: DataFrame, max_dist: int = 2, prefix: int = 7) -> DataFrame:
    """(tok, best, dist): the closest term, then the most frequent, then the
    smallest; tokens with no candidate map to themselves (dist NULL).

    A token that is itself a dictionary term is its own closest term
    (distance 0), so only out-of-dictionary tokens enter the delete join.  It
    runs by distance: a token with a term one edit away (few keys, few pairs)
    is settled, and only the others are compared with terms two edits away."""
    base, dictionary = cut_lineage(tokens.select("tok").distinct()), cut_lineage(dictionary)
    terms = dictionary.select(F.col("term").alias("tok"))
    known = base.join(terms, "tok", "left_semi").select("tok", F.col("tok").alias("best"),
                                                         F.lit(0).cast("int").alias("dist"))
    oov = cut_lineage(base.join(terms, "tok", "left_anti"))
    best, rest = None, oov
    for d in range(1, max_dist + 1):
        near = cut_lineage(_near_pairs(rest, dictionary, d, prefix).groupBy("tok").agg(
            F.min_by(F.struct("term", "dist"), F.struct("dist", (-F.col("freq")).alias("nf"), "term")).alias("b")))
        best = near if best is None else best.unionByName(near)
        if d < max_dist:
            rest = cut_lineage(rest.join(near, "tok", "left_anti"))
    rest = (oov.join(best, "tok", "left")
            .select("tok", F.coalesce(F.col("b.term"), F.col("tok")).alias("best"), F.col("b.dist").alias("dist")))
    return known.unionByName(rest)


# -------------------------------------------------------------- normaliser --

def normalize_table(tokens: DataFrame, local_dictionary: DataFrame, short_forms=None) -> DataFrame:
    """(tok, norm): short form -> full form by lexicon; otherwise the
    closest word of the local-language dictionary; otherwise the token."""
    short_forms = L.MALAY_SHORT_FORMS if short_forms is None else short_forms
    spark = tokens.sparkSession
    sf = spark.createDataFrame(L.dedupe_pairs(short_forms), "tok string, full string")
    sb = spell_best(tokens, local_dictionary)
    return (sb.join(F.broadcast(sf), "tok", "left")
            .select("tok", F.coalesce("full", "best").alias("norm")))


# ------------------------------------------------------------ tags, lemmas --

def pos_tag(tok: Column) -> Column:
    """A suffix heuristic Penn tag for a single word (no tagger model)."""
    n = F.length(tok)
    return (F.when(tok.endswith("ing") & (n > 4), "VBG")
            .when(tok.endswith("ed") & (n > 3), "VBD")
            .when(tok.endswith("ly") & (n > 3), "RB")
            .when(tok.rlike("(ous|ful|ive|able|ible|al|ic)$") & (n > 4), "JJ")
            .when(tok.endswith("s") & (n > 3) & ~tok.endswith("ss"), "NNS")
            .otherwise("NN"))


def pos_to_class(tag: Column) -> Column:
    """J/V/N/R -> adjective/verb/noun/adverb classes, else NULL."""
    first = F.substring(tag, 1, 1)
    return (F.when(first == "J", "a").when(first == "V", "v")
            .when(first == "N", "n").when(first == "R", "r"))


def lemma_table(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tok, lemma): detachment rules for the word's class; a candidate
    counts only if the vocabulary holds it; the shortest wins (rule order on
    ties); no candidate keeps the word."""
    t = tokens.select("tok").distinct().withColumn("cls", F.coalesce(pos_to_class(pos_tag(F.col("tok"))), F.lit("n")))
    arms = []
    for cls, rules in MORPHY_RULES.items():
        cands = [F.struct(F.lit(0).alias("i"), F.col("tok").alias("c"))]
        for i, (suf, rep) in enumerate(rules, start=1):
            cands.append(F.struct(F.lit(i).alias("i"), F.when(
                F.col("tok").endswith(suf) & (F.length("tok") > len(suf)),
                F.concat(F.expr(f"substring(tok, 1, length(tok) - {len(suf)})"), F.lit(rep))).alias("c")))
        arms.append((cls, F.array(*cands)))
    expr = None
    for cls, arr in arms:
        expr = F.when(F.col("cls") == cls, arr) if expr is None else expr.when(F.col("cls") == cls, arr)
    ex = t.select("tok", F.explode(expr).alias("x")).select("tok", "x.i", "x.c").filter(F.col("c").isNotNull())
    voc = vocabulary.select(F.col("term").alias("c")).distinct()
    ok = ex.join(voc, "c", "left_semi")
    best = ok.groupBy("tok").agg(F.min_by("c", F.struct(F.length("c"), F.col("i"))).alias("lemma"))
    return t.join(best, "tok", "left").select("tok", F.coalesce("lemma", "tok").alias("lemma"))


def stem_table(tokens: DataFrame, roots: DataFrame) -> DataFrame:
    """(tok, stem): Malay affix stripping.  Candidates in order: prefix and
    suffix, prefix, suffix (each in rule order); the first whose remainder
    is a known root of at least three letters wins; else the token."""
    t = tokens.select("tok").distinct()
    cands, i = [], 0

    def strip(col, pre, suf):
        c = col
        cond = F.lit(True)
        if pre:
            cond = cond & c.startswith(pre)
        if suf:
            cond = cond & c.endswith(suf)
        rest = F.expr(f"substring(tok, {len(pre) + 1}, length(tok) - {len(pre) + len(suf)})")
        return F.when(cond & (F.length(c) - len(pre) - len(suf) >= MIN_ROOT_LEN), rest)

    for pre in MALAY_PREFIXES:
        for suf in MALAY_SUFFIXES:
            cands.append(F.struct(F.lit(i).alias("i"), strip(F.col("tok"), pre, suf).alias("c")))
            i += 1
    for pre in MALAY_PREFIXES:
        cands.append(F.struct(F.lit(i).alias("i"), strip(F.col("tok"), pre, "").alias("c")))
        i += 1
    for suf in MALAY_SUFFIXES:
        cands.append(F.struct(F.lit(i).alias("i"), strip(F.col("tok"), "", suf).alias("c")))
        i += 1
    live = F.filter(F.array(*cands), lambda x: x["c"].isNotNull())
    ex = t.select("tok", F.explode(live).alias("x")).select("tok", "x.i", "x.c")
    ok = ex.join(roots.select(F.col("term").alias("c")).distinct(), "c", "left_semi")
    best = ok.groupBy("tok").agg(F.min_by("c", F.col("i")).alias("stem"))
    return t.join(best, "tok", "left").select("tok", F.coalesce("stem", "tok").alias("stem"))


# ----------------------------------------------------- composite tables --

def correct_table(tokens: DataFrame, lang_table: DataFrame, proper: DataFrame,
                  en_dict: DataFrame, local_dict: DataFrame, special, english: str = "en",
                  short_forms=None) -> DataFrame:
    """(tok, out) for correct(): special word -> kept; proper noun -> kept;
    English -> closest dictionary word; else -> normalised (an empty result
    keeps the token).  Spelling runs only on English tokens and the
    normaliser only on the others."""
    t = tokens.select("tok").distinct().join(lang_table, "tok", "left")
    pn = proper.select("tok", F.lit(True).alias("is_proper"))
    t = cut_lineage(t.join(pn, "tok", "left"))  # read for each kind of token
    keep = F.col("tok").isin(list(special)) | F.coalesce(F.col("is_proper"), F.lit(False))
    is_en = F.coalesce(F.col("lang") == english, F.lit(False))
    kept = t.filter(keep).select("tok", F.col("tok").alias("out"))
    en = t.filter(~keep & is_en).select("tok")
    other = t.filter(~keep & ~is_en).select("tok")
    sp = spell_best(en, en_dict).select("tok", F.col("best").alias("out"))
    nm = normalize_table(other, local_dict, short_forms).select(
        "tok", F.when(F.coalesce(F.col("norm"), F.lit("")) == "", F.col("tok")).otherwise(F.col("norm")).alias("out"))
    return kept.unionByName(sp).unionByName(nm)


def stem_lemma_table(tokens: DataFrame, lang_table: DataFrame, vocabulary_en: DataFrame,
                     roots: DataFrame, standard, english: str = "en") -> DataFrame:
    """(tok, out) for stem_lemma(): standard words kept; English -> lemma;
    else -> Malay stem.  Lemmas are computed for English tokens only and
    stems for the others."""
    t = cut_lineage(tokens.select("tok").distinct().join(lang_table, "tok", "left"))  # read for each kind of token
    std = F.col("tok").isin(list(standard))
    is_en = F.coalesce(F.col("lang") == english, F.lit(False))
    kept = t.filter(std).select("tok", F.col("tok").alias("out"))
    lm = lemma_table(t.filter(~std & is_en).select("tok"), vocabulary_en).select("tok", F.col("lemma").alias("out"))
    st = stem_table(t.filter(~std & ~is_en).select("tok"), roots).select("tok", F.col("stem").alias("out"))
    return kept.unionByName(lm).unionByName(st)


def split_prefix_table(tokens: DataFrame, lang_table: DataFrame, special, english: str = "en") -> DataFrame:
    """(tok, out ARRAY) for split_x(): a token starting with ``x`` that is
    neither special nor English loses its ``x`` into its own token."""
    t = tokens.select("tok").distinct().filter(F.col("tok").startswith("x")).join(lang_table, "tok", "left")
    split = (~F.col("tok").isin(list(special))) & F.coalesce(F.col("lang") != english, F.lit(True)) \
        & (F.length("tok") > 1)
    out = F.when(split, F.array(F.lit("x"), F.substring("tok", 2, 1 << 20))).otherwise(F.array("tok"))
    return t.select("tok", out.alias("out"))


# ------------------------------------------------- char n-gram language model --

#: Longest character n-gram of the language model.
GRAM = 3


def grams(tok: Column, longest: int = GRAM) -> Column:
    """All character n-grams of 1 to ``longest`` letters of <token>, with repeats."""
    w = F.concat(F.lit("<"), tok, F.lit(">"))

    def of(n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, n))

    return F.concat(*[of(n) for n in range(1, longest + 1)])


def language_model(lang_table: DataFrame, longest: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes over character n-grams, learned from a (tok,
    lang) table: (gram, lang, weight), what a seen n-gram adds to a language's
    log-likelihood over an unseen one, and (lang, prior, floor), a row per
    language, where floor is the log-likelihood of an n-gram the language has
    never shown (add-one smoothing over all n-grams)."""
    seen = cut_lineage(lang_table.select("lang", F.explode(grams(F.col("tok"), longest)).alias("gram"))
                       .groupBy("gram", "lang").agg(F.count(F.lit(1)).alias("n")))
    known = seen.select("gram").distinct().count()
    per = seen.groupBy("lang").agg((-F.log(F.sum("n") + known)).alias("floor"))
    words = lang_table.groupBy("lang").agg(F.count(F.lit(1)).alias("words"))
    total = lang_table.count()
    langs = words.join(per, "lang").select("lang", F.log(F.col("words") / F.lit(float(max(total, 1)))).alias("prior"), "floor")
    return seen.select("gram", "lang", F.log(F.col("n") + 1).alias("weight")), langs


def language_of(tokens: DataFrame, model: tuple[DataFrame, DataFrame], longest: int = GRAM) -> DataFrame:
    """(tok, lang_pred) for distinct tokens, seen before or not: the language of
    the largest summed log-likelihood (of equal ones the smaller name).  Every
    token starts with each language's prior and floors; its n-grams meet the
    weights in a join, and the sums decide."""
    weights, langs = model
    rows = langs.orderBy("lang").collect()  # one row per language
    if not rows:
        return tokens.select("tok", F.lit(None).cast("string").alias("lang_pred"))
    base = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["prior"]).alias("prior"), F.lit(r["floor"]).alias("floor")) for r in rows])
    t = tokens.select("tok").distinct()
    start = t.select("tok", F.size(grams(F.col("tok"), longest)).alias("n"), F.explode(base).alias("l")).select(
        "tok", "l.lang", (F.col("l.prior") + F.col("n") * F.col("l.floor")).alias("score"))
    each = t.select("tok", F.explode(grams(F.col("tok"), longest)).alias("gram")).groupBy("tok", "gram").agg(F.count(F.lit(1)).alias("n"))
    met = each.join(weights, "gram").select("tok", "lang", (F.col("n") * F.col("weight")).alias("score"))
    score = start.unionByName(met).groupBy("tok", "lang").agg(F.round(F.sum("score"), 6).alias("score"))
    return score.groupBy("tok").agg(F.min_by("lang", F.struct((-F.col("score")).alias("s"), "lang")).alias("lang_pred"))
