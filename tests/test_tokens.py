import random

from pyspark.sql import functions as F

from textlens.operators import linguistics as G
from textlens.operators import topics as TP


def osa(a, b):
    """Optimal string alignment: a swap of neighbours costs one edit."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance_matches_the_table_of_all_prefixes(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(130)] + ["ca", "abc", "the", "teh"]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", G.osa(F.col("a"), F.col("b")).alias("d")).collect():
        want = osa(r["a"], r["b"])
        assert r["d"] == (want if want <= 2 else None), r


def test_candidates_are_complete_for_short_and_long_words(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 12))) for _ in range(160)})
    toks = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 12))) for _ in range(120)})
    d = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, freq long")
    got = {(r["tok"], r["term"]): r["dist"] for r in G.spell_candidates(spark.createDataFrame([(t,) for t in toks], "tok string"), d).collect()}
    # the delete keys are those of a prefix, so words are compared there first: complete for words up to the prefix length
    assert got == {(t, w): osa(t, w) for t in toks for w in words if osa(t, w) <= 2}


def test_swapped_letters_are_one_edit(spark):
    d = spark.createDataFrame([("the", 500), ("tea", 90), ("ten", 80), ("eh", 300)], "term string, freq long")
    got = {r["tok"]: (r["best"], r["dist"]) for r in G.spell_best(spark.createDataFrame([("teh",), ("hte",)], "tok string"), d).collect()}
    assert got == {"teh": ("the", 1), "hte": ("the", 1)}


def test_grams_of_a_token(spark):
    got = spark.createDataFrame([("ab",), ("",)], "tok string").select(G.grams(F.col("tok"))).collect()
    assert [r[0] for r in got] == [["<", "a", "b", ">", "<a", "ab", "b>", "<ab", "ab>"], ["<", ">", "<>", "<>"]]


def test_language_model_labels_unseen_tokens(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choice("aeiou" if i % 2 else "xzkqw") for _ in range(5)) + str(i), "vowels" if i % 2 else "others") for i in range(120)]
    model = G.language_model(spark.createDataFrame(rows, "tok string, lang string"))
    new = spark.createDataFrame([("aeo",), ("zkx",), ("uuuuuu",), ("€",)], "tok string")
    got = {r["tok"]: r["lang_pred"] for r in G.language_of(new, model).collect()}
    assert (got["aeo"], got["uuuuuu"], got["zkx"]) == ("vowels", "vowels", "others") and got["€"] in ("vowels", "others")
    none = G.language_model(spark.createDataFrame([], "tok string, lang string"))
    assert [r["lang_pred"] for r in G.language_of(new, none).collect()] == [None] * 4


def test_deletes_bounded(spark):
    df = spark.createDataFrame([("abcdefghij",), ("ab",)], "w string")
    sizes = [r[0] for r in df.select(F.size(G.deletes(F.col("w")))).collect()]
    assert sizes[0] <= 29 and sizes[1] == 4  # ab, b, a, ''


def test_spell_best_matches_brute_force(spark):
    terms = [("train", 50), ("rain", 40), ("station", 30), ("late", 20), ("plate", 25), ("delay", 10)]
    toks = ["trian", "stasion", "lat", "dlay", "xyzzy", "train", "rainn"]
    d = spark.createDataFrame(terms, "term string, freq long")
    t = spark.createDataFrame([(x,) for x in toks], "tok string")
    got = {r["tok"]: r["best"] for r in G.spell_best(t, d).collect()}
    for x in toks:
        c = [(osa(x, w), -f, w) for w, f in terms if osa(x, w) <= 2]
        assert got[x] == (min(c)[2] if c else x), x


def test_resolve_tokens_order_and_empty(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "row_id long, toks array<string>")
    table = spark.createDataFrame([("b", ["x", "y"])], "tok string, out array<string>")
    got = {r["row_id"]: r["o"] for r in G.resolve_tokens(df, "toks", table, "o").collect()}
    assert got == {1: ["x", "y", "a", "x", "y"], 2: []}


def test_phrase_apply_greedy(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "a", "b"]), (2, ["a", "b", "a", "b"]), (3, ["b"]), (4, []), (5, None)],
                               "row_id long, t array<string>")
    phrases = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    got = {r["row_id"]: r["t"] for r in TP.phrase_apply(df, "t", phrases).collect()}
    assert got == {1: ["a_b", "c", "a_b"], 2: ["a_b", "a_b"], 3: ["b"], 4: [], 5: None}


def test_split_prefix(spark):
    toks = spark.createDataFrame([("xnak",), ("xpress",), ("xray",), ("x",)], "tok string")
    lang = spark.createDataFrame([("xray", "en")], "tok string, lang string")
    got = {r["tok"]: r["out"] for r in G.split_prefix_table(toks, lang, ["xpress"]).collect()}
    assert got == {"xnak": ["x", "nak"], "xpress": ["xpress"], "xray": ["xray"], "x": ["x"]}


def test_lemma_rules(spark):
    toks = spark.createDataFrame([("stations",), ("waiting",), ("boxes",)], "tok string")
    vocab = spark.createDataFrame([("station", 1), ("wait", 1), ("box", 1)], "term string, freq long")
    got = {r["tok"]: r["lemma"] for r in G.lemma_table(toks, vocab).collect()}
    assert got == {"stations": "station", "waiting": "wait", "boxes": "box"}


def test_language_model_learns_scripts(spark):
    rows = [(w, "en") for w in ["the", "there", "this", "that", "then", "they", "other", "weather"]] + \
           [(w, "fr") for w in ["eau", "beaux", "château", "gâteau", "oiseau", "peau", "bureau", "niveau"]]
    table = spark.createDataFrame(rows, "tok string, lang string")
    test = spark.createDataFrame([("these",), ("rideau",)], "tok string")
    got = {r["tok"]: r["lang_pred"] for r in G.language_of(test, G.language_model(table)).collect()}
    assert got == {"these": "en", "rideau": "fr"}
