"""Lexicons and literal parameters.

Two groups live here:

* FIXED VALUES that must equal the reference workflow for equal results
  (author list, term filters, domain token map, keep-list, laughter
  patterns, grids, seeds).  They are written plainly, in their natural order.
* Our own small lexicons standing in for files the reference reads but does
  not ship (station names, special words, local stop words, slang
  replacements).  Every lexicon is a parameter of the operators; these are
  only defaults.

The English stop-word list is the public NLTK English list.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ============================================================================
# FIXED VALUES (must equal the reference workflow)
# ============================================================================

# Accounts whose posts are dropped before cleaning.
EXCLUDED_AUTHORS = [
    "ktm_berhad", "aduanMOT", "MyRapidKL", "AskRapidKL", "AsianBuses",
    "AstroRadioNews", "MRTMalaysia", "APADChannel", "Rapidpg",
    "Salak_Selatan", "KLIAtransit",
]

# Substring terms (case-sensitive regex alternation) that keep a post.
INCLUDE_TERMS = ["Lrt", "lrt", "Mrt", "mrt", "Monorail", "monorail",
                 "station", "train", "carriage"]

# Substring terms that drop a post.
EXCLUDE_TERMS = [
    "bus", "bas", "brt", "Brt", "driver", "drebar", "drivers", "ktm", "ecrl",
    "ecrls", "erls", "erl", "ktm_berhad", "ktm berhad", "uitm", "puncak alam",
    "air selangor", "ukm", "dbkl", "upm", "puncak perdana", "rapid penang",
    "rapidpenang", "klia express", "kliaexpress",
]

# Domain token map, rules in order; the first rule holding a token wins.
DOMAIN_RULES = [
    (["hentian", "st", "stn", "stesen", "stesyen", "stsn", "stsyn", "stesn"], "station"),
    (["rel", "rail", "keretapi", "tren", "trin"], "train"),
    (["koc", "gerabak", "gerabk", "grbk", "coach"], "carriage"),
    (["lrts", "mrts", "mrls", "brts", "monorels", "monorails"], "<drop last letter>"),
    (["monorel", "monorail", "mrl"], "Monorail"),
    (["rapidkl", "myrapid", "myrapidkl", "rpidkl"], "Rapidkl"),
    (["bas"], "bus"),
    (["lrt", "mrt", "mrl", "brt", "monorail"], "<title case>"),
]

# Words never treated as stop words.  The reference intends this list; its
# missing comma glues "out" and "how" into "outhow" (parity option below).
KEEP_WORDS = [
    "time", "from", "where", "again", "after", "through", "because", "which",
    "who", "when", "what", "to", "but", "until", "out", "how", "why", "in",
    "then", "here", "all", "any", "few", "more", "most", "other", "some", "no",
    "not", "only", "same", "too", "now", "during", "for", "at", "of",
]

# Laughter expressions, applied in this order, each replaced by "laugh".
LAUGH_PATTERNS = [
    r"\b(?:[aeiou]{0,2}h{1,2}[aeiou]{0,2}){2,}h?\b",
    r"\b(?:[o]{0,2}l{1,2}[o]{0,2}){2,}l?\b",
    r"\b(?:[k]{1,2}[aeiou]{0,2}[h]{0,2}[aeiou]{0,2}){2,}\b",
]

# Tokens masked before topic modelling.
TOPIC_MASK_TOKENS = ["Lrt", "Mrt", "Monorail", "train", "Rapidkl"]

# Tokenizer of the cleaning chain: words with apostrophes, or punctuation runs.
# (Python's \w and \s are spelled out as classes in functions/patterns.py.)

# Topic-model settings.
PHRASE_MIN_COUNT = 5
PHRASE_THRESHOLD = 100.0
DICT_NO_BELOW = 4
DICT_NO_ABOVE = 0.5
DICT_KEEP_N = 100000
LDA_BASIC = dict(passes=100, seed=100)
LDA_TUNED_EN = dict(k=5, chunk=100, passes=50, alpha="asymmetric", eta=0.91, seed=100)
LDA_TUNED_MS = dict(k=8, chunk=100, passes=50, alpha="asymmetric", eta=0.91, seed=100)
LDA_GRID_TOPICS = [2, 3, 4, 5, 6, 7]
LDA_GRID_ALPHA = [0.01, 0.31, 0.61, 0.91, "symmetric", "asymmetric"]
LDA_GRID_BETA = [0.01, 0.31, 0.61, 0.91, "symmetric"]
COHERENCE_WINDOW = 110
COHERENCE_TOPN = 20
TOPIC_TERMS_N = 30

# Word-vector settings.
W2V_EN = dict(size=900, window=6, min_count=1, negative=2, iters=100, seed=34)
W2V_MS = dict(size=800, window=10, min_count=2, negative=5, iters=100, seed=34)
W2V_CONTINUE_EPOCHS = 10
NEAREST_TOPN = 10

# Classifier grids.
RF_GRID_EN = dict(trees=[4, 6, 7, 9, 10, 12, 14], features=["log2", "sqrt", "auto"],
                  criterion=["entropy", "gini"], depth=[2, 3, 5, 10, 14],
                  split=[2, 3, 5, 8, 10], leaf=[1, 5, 8, 10])
RF_GRID_MS = dict(trees=[4, 6, 7, 9, 10, 12], features=["log2", "sqrt", "auto"],
                  criterion=["entropy", "gini"], depth=[2, 3, 5, 10, 14],
                  split=[2, 3, 5, 8], leaf=[1, 5, 8, 10])
GBT_GRID = dict(depth=[2, 3, 4, 5, 6, 7, 8, 9], trees=[60, 100, 140, 180],
                rate=[0.1, 0.01, 0.05])
SVM_GRID = dict(C=[1000, 10000, 100000], kernel=["rbf", "linear", "poly"],
                gamma=[0.001, 0.003, 0.005, 0.007, 0.009, 0.10, 0.5])
CV_FOLDS = 10
# The forest search names no fold number: the library's default at that time (before its 0.22).
RF_GRID_FOLDS = 3
TEST_SIZE = 0.30
SEEDS = dict(split_en=30, split_ms=50, vectors=34, topics=100, boosted=42, folds=7)

# NLTK's sentence-free word tokenizer splits these words (case-insensitive)
# after three letters; on cleaned text this is its only difference from a
# whitespace split.
NLTK_SPLIT_WORDS = ["cannot", "gimme", "gonna", "gotta", "lemme", "wanna"]

# ============================================================================
# Public NLTK English stop-word list
# ============================================================================

ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "s", "t", "can", "will", "just",
    "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re",
    "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven",
    "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't",
    "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn",
    "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# ============================================================================
# Our own default lexicons (stand-ins for files the reference does not ship)
# ============================================================================

STATION_NAMES = [
    "ampang park", "klcc", "kl sentral", "masjid jamek", "pasar seni",
    "bukit bintang", "sri petaling", "sentul", "titiwangsa", "bandaraya",
    "hang tuah", "plaza rakyat", "kelana jaya", "gombak", "putra heights",
    "chan sow lin", "maluri", "bangsar", "abdullah hukum", "kajang",
    "sungai buloh", "muzium negara", "merdeka", "imbi", "raja chulan",
    "bukit nanas", "medan tuanku", "chow kit", "dang wangi", "kampung baru",
]

SPECIAL_WORDS = [
    "Lrt", "Mrt", "Monorail", "Rapidkl", "station", "train", "carriage",
    "ktm", "klcc", "erl", "xpress", "touch", "go",
]

MALAY_STOPWORDS = [
    "yang", "dan", "di", "ke", "dari", "ini", "itu", "dengan", "untuk", "pada",
    "adalah", "saya", "aku", "kau", "dia", "kita", "kami", "mereka", "nak",
    "dah", "lah", "je", "pun", "ada", "akan", "juga", "atau", "tu", "ni",
    "kat", "pula", "lagi", "sudah", "telah", "sangat", "boleh", "bila",
    "kalau", "jadi", "macam", "apa", "sebab", "oleh", "tapi", "kan", "ya",
]

# Slang / short forms to standard words (applied as whole-word alternation in
# this order).
REPLACEMENTS = [
    ("st", "station"), ("stn", "station"), ("tak boleh", "cannot"),
    ("x boleh", "cannot"), ("yg", "yang"), ("dgn", "dengan"), ("utk", "untuk"),
    ("sbb", "sebab"), ("mcm", "macam"), ("sgt", "sangat"), ("lmbt", "lambat"),
    ("lmbat", "lambat"), ("jem", "jam"), ("u", "you"), ("ur", "your"),
    ("r", "are"), ("n", "and"), ("nd", "and"), ("pls", "please"),
    ("plz", "please"), ("thx", "thanks"), ("tq", "thank you"), ("ppl", "people"),
    ("btw", "by the way"), ("idk", "i do not know"), ("omg", "oh my god"),
]

ENGLISH_REPLACEMENTS = [
    ("wait", "delay"), ("waiting", "delay"), ("late", "delay"),
    ("crowded", "crowd"), ("packed", "crowd"), ("broke", "breakdown"),
    ("broken", "breakdown"), ("th", "the"),
]

SENTIMENT_REPLACEMENTS = [
    ("gud", "good"), ("gr8", "great"), ("bst", "best"), ("teruk", "bad"),
    ("hampeh", "bad"), ("haha", "laugh"), ("best", "good"),
]

# Corpus-specific extra stop words for topic modelling.
TOPIC_STOPWORDS = ["laugh", "please", "thank", "thanks", "today", "guys", "one"]

# Malay short forms for the normaliser.
MALAY_SHORT_FORMS = [
    ("x", "tidak"), ("tak", "tidak"), ("tk", "tidak"), ("nk", "nak"),
    ("sy", "saya"), ("kt", "dekat"), ("dkt", "dekat"), ("blh", "boleh"),
    ("bleh", "boleh"), ("jln", "jalan"), ("org", "orang"), ("kpd", "kepada"),
    ("dlm", "dalam"), ("sj", "sahaja"), ("je", "sahaja"), ("ke", "ke"),
]

# Common English contractions (text is lower-case when this runs).
CONTRACTIONS = [
    ("ain't", "are not"), ("aren't", "are not"), ("can't", "cannot"),
    ("couldn't", "could not"), ("didn't", "did not"), ("doesn't", "does not"),
    ("don't", "do not"), ("hadn't", "had not"), ("hasn't", "has not"),
    ("haven't", "have not"), ("he'd", "he would"), ("he'll", "he will"),
    ("he's", "he is"), ("i'd", "i would"), ("i'll", "i will"), ("i'm", "i am"),
    ("i've", "i have"), ("isn't", "is not"), ("it'd", "it would"),
    ("it'll", "it will"), ("it's", "it is"), ("let's", "let us"),
    ("mustn't", "must not"), ("shan't", "shall not"), ("she'd", "she would"),
    ("she'll", "she will"), ("she's", "she is"), ("shouldn't", "should not"),
    ("that's", "that is"), ("there's", "there is"), ("they'd", "they would"),
    ("they'll", "they will"), ("they're", "they are"), ("they've", "they have"),
    ("wasn't", "was not"), ("we'd", "we would"), ("we're", "we are"),
    ("we've", "we have"), ("weren't", "were not"), ("what's", "what is"),
    ("where's", "where is"), ("who's", "who is"), ("won't", "will not"),
    ("wouldn't", "would not"), ("y'all", "you all"), ("you'd", "you would"),
    ("you'll", "you will"), ("you're", "you are"), ("you've", "you have"),
]

# Proper names kept as they are by the corrector.
NAME_WORDS = ["Lrt", "Mrt", "Monorail", "Rapidkl", "Prasarana", "Ampang",
              "Kelana", "Sentul", "Gombak", "Kajang"]


def dedupe_pairs(pairs):
    """Map-lexicon load rule: a repeated key keeps its first position and
    takes the last value."""
    order, vals = [], {}
    for k, v in pairs:
        if k not in vals:
            order.append(k)
        vals[k] = v
    return [(k, vals[k]) for k in order]


def domain_pairs():
    """DOMAIN_RULES flattened to (token, output) with first-rule-wins."""
    out = {}
    for toks, target in DOMAIN_RULES:
        for t in toks:
            if t in out:
                continue
            if target == "<drop last letter>":
                out[t] = t[:-1]
            elif target == "<title case>":
                out[t] = t[:1].upper() + t[1:].lower()
            else:
                out[t] = target
    return list(out.items())


def distinct_words(phrases):
    seen, out = set(), []
    for p in phrases:
        for w in p.split():
            if w not in seen:
                seen.add(w)
                out.append(w)
    return out


@dataclass(frozen=True)
class Lexicons:
    """Every lexicon the cleaning chain consults; pass a modified copy to
    change one (``lex.with_(stations=[...])``)."""

    stations: list = field(default_factory=lambda: list(STATION_NAMES))
    special: list = field(default_factory=lambda: list(SPECIAL_WORDS))
    local_stop: list = field(default_factory=lambda: list(MALAY_STOPWORDS))
    english_stop: list = field(default_factory=lambda: list(ENGLISH_STOPWORDS))
    keep: list = field(default_factory=lambda: list(KEEP_WORDS))
    replacements: list = field(default_factory=lambda: list(REPLACEMENTS))
    replacements_en: list = field(default_factory=lambda: list(ENGLISH_REPLACEMENTS))
    replacements_senti: list = field(default_factory=lambda: list(SENTIMENT_REPLACEMENTS))
    topic_stop: list = field(default_factory=lambda: list(TOPIC_STOPWORDS))
    short_forms: list = field(default_factory=lambda: list(MALAY_SHORT_FORMS))
    contractions: list = field(default_factory=lambda: list(CONTRACTIONS))
    names: list = field(default_factory=lambda: list(NAME_WORDS))
    include_terms: list = field(default_factory=lambda: list(INCLUDE_TERMS))
    exclude_terms: list = field(default_factory=lambda: list(EXCLUDE_TERMS))
    excluded_authors: list = field(default_factory=lambda: list(EXCLUDED_AUTHORS))
    parity_keep_list: bool = False

    def with_(self, **kw) -> "Lexicons":
        return replace(self, **kw)

    # derived lexicons ---------------------------------------------------
    def keep_set(self):
        if self.parity_keep_list:
            k = [w for w in self.keep if w not in ("out", "how")] + ["outhow"]
            return k
        return list(self.keep)

    def stopwords(self):
        """Local list + English list, minus the keep-list, de-duplicated."""
        keep = set(self.keep_set())
        out, seen = [], set()
        for w in list(self.local_stop) + list(self.english_stop):
            if w not in keep and w not in seen:
                seen.add(w)
                out.append(w)
        return out

    def special_words(self):
        """Special words plus the single words of the station names."""
        out = list(self.special)
        for w in distinct_words(self.stations):
            if w not in out:
                out.append(w)
        return out

    def standard_words(self):
        """Words of the replacement values plus the special words."""
        out = distinct_words(v for _, v in dedupe_pairs(self.replacements))
        for w in distinct_words(self.special_words()):
            if w not in out:
                out.append(w)
        return out

    def include_all(self):
        return list(self.include_terms) + list(self.stations)


DEFAULT = Lexicons()
