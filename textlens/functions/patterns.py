"""Character classes shared by the JVM regex engine and RE2.

The reference runs Python's ``re`` on ``str``.  Java's ``\\w``/``\\s`` and
RE2's differ from Python's, so every class is spelled out; the same pattern
text then means the same thing in Spark and in the DuckDB oracle.
"""

# Python's Unicode \s
WS = (r"\t\n\x0B\f\r \x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Python's Unicode \w
W = r"\p{L}\p{N}_"

# The cleaning tokenizer: words (with apostrophes) or runs of punctuation.
TOKEN = rf"[{W}']+|[^{W}{WS}]+"
# The same for the JVM engine, which tests the parts of a class one after
# another: the commonest letters first.
JAVA_W = rf"a-z{W}"
JAVA_TOKEN = rf"[{JAVA_W}']+|[^{JAVA_W}{WS}]+"

# Whitespace runs
WS_RUN = rf"[{WS}]+"
NOT_WS_RUN = rf"[^{WS}]+"

_SPECIAL = set(r"\.^$|?*+()[]{}")


def escape(s: str) -> str:
    """Escape a literal for both engines (backslash before ASCII punctuation)."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in s)


def word_alternation(keys) -> str:
    """Whole-word alternation in the given order (first match wins).

    ``\\b(?:k1|k2|...)\\b`` equals ``\\bk1\\b|\\bk2\\b|...``: when the
    trailing boundary fails after one key the engine backtracks into the next
    key, so the first key that matches as a whole word still wins; but the
    leading boundary is tested once per position instead of once per key."""
    return r"\b(?:" + "|".join(escape(k) for k in keys) + r")\b"


def word_trie(keys) -> str:
    """The matches of ``word_alternation`` by a pattern that branches letter by
    letter, so a place costs a few tests and not one for each key.  Keys that
    begin with different letters never match at one place, so gathering keys
    by letter leaves the order of those that can; a key that ends here keeps
    its place between the longer ones."""
    return r"\b(?:" + _branches([list(k) for k in dict.fromkeys(keys)]) + r")\b"


def _branches(keys: list[list[str]]) -> str:
    out: list[str] = []
    by_letter: dict[str, list[list[str]]] = {}

    def flush():
        for ch, rests in by_letter.items():
            tail = escape("".join(rests[0])) if len(rests) == 1 else f"(?:{_branches(rests)})"
            out.append(escape(ch) + tail)
        by_letter.clear()
    for key in keys:
        if key:
            by_letter.setdefault(key[0], []).append(key[1:])
        else:
            flush()
            out.append("")
    flush()
    return "|".join(out)


def substring_alternation(terms, quote: bool = True) -> str:
    return "|".join(escape(t) if quote else t for t in terms)


# Linear-time equivalents of lexicons.LAUGH_PATTERNS (same matches).
#
# Each reference pattern is a whole-word match (\b on both sides, letters
# only) of a repeated group with optional parts, e.g.
# (?:[aeiou]{0,2}h{1,2}[aeiou]{0,2}){2,}h?.  A vowel run between two h's can
# be shared out between neighbouring repetitions in several ways, so a
# backtracking engine explores exponentially many splits when a long
# "hahaha..." word fails at its end.  The words matched are exactly: at
# least two h's (l's, k's), leading/trailing runs of at most two vowels,
# runs between of at most four (for k: each gap one of the group's tails).
# Written that way each character has one place to go.
_KSEG = r"(?:[aeiou]{0,2}h{1,2}[aeiou]{0,2}|[aeiou]{0,4})"
LAUGH_LINEAR = [
    r"\b[aeiou]{0,2}h(?:[aeiou]{0,4}h)+[aeiou]{0,2}\b",
    r"\bo{0,2}l(?:o{0,4}l)+o{0,2}\b",
    rf"\bk(?:{_KSEG}k)+{_KSEG}\b",
]
