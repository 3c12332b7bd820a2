"""License scans: identifier tags and notice phrases found by Aho-Corasick, and
licence expressions evaluated by a shunting-yard parser.

A text's words (lower-case letters, digits and all characters beyond ASCII)
are joined by single blanks, and one automaton of all phrases runs over them
once.  After each identifier tag the expression is read from the text: names
joined by AND, OR and WITH (binding tightest) with parentheses, up to where
it ends or breaks off.  An expression is worth the least of its parts joined
by AND, the most of those joined by OR; an exception after WITH loosens a
licence half-way to a permissive one.  The score of a text is the least worth
of what it carries: 1 for permissive terms only, 0 if all rights are reserved,
and 0.5 if no notice is found.

Null and empty texts have no words and no labels, score 0.5; equal texts give
equal rows, a repeated id a row each time, an empty table none.  Phrases that
start together count once, as the longest; a base phrase inside a longer notice
keeps its place and label but adds no worth of its own.  Time grows with the
length of a text, whatever it holds.  Only the id and text columns are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, register, slices, table

# Phrases whose places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit": "mit",
    "licensed under the apache": "apache",
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "the unlicense": "unlicense",
    "released into the public domain": "public-domain",
    "cc0 1 0": "cc0",
    "cc zero": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
}
# What a label is worth.
WORTH = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0,
    "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "cddl": 0.7, "eupl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.6,
    "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nd": 0.2, "cc-by-nc-nd": 0.1,
    "all-rights-reserved": 0.0,
}
TAG, TAG_WORDS = "spdx-license-identifier", "spdx license identifier"
UNKNOWN = 0.5

_FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_NAME = re.compile(r"\s*(?:([()])|([a-z0-9][a-z0-9.+-]*))")
_ORDER = {"or": 1, "and": 2, "with": 3}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def family(name: str) -> str | None:
    """The label of a licence name such as gpl-3.0-or-later."""
    name = name.rstrip("+.-")
    parts = name.split("-")
    for n in range(len(parts), 0, -1):
        label = "-".join(parts[:n])
        if label in WORTH:
            return label
    return {"0bsd": "bsd", "gplv2": "gpl", "gplv3": "gpl", "lgplv3": "lgpl", "agplv3": "agpl"}.get(parts[0])


def expression(text: str) -> tuple[list[str], float | None]:
    """The labels and the worth of the licence expression that ``text`` (lower
    case) starts with; no worth if no licence in it is known."""
    values: list[float | None] = []
    pending: list[str] = []
    labels: list[str] = []

    def apply(op: str) -> None:
        b, a = values.pop(), values.pop()
        if op == "with":
            values.append(None if a is None else (1 + a) / 2)
        elif a is None or b is None:
            values.append(b if a is None else a)
        else:
            values.append(min(a, b) if op == "and" else max(a, b))

    at, operand = 0, True  # operand: a name or "(" comes next
    after_with = False
    while True:
        m = _NAME.match(text, at)
        if not m:
            break
        sign, name = m[1], m[2]
        if operand:
            if sign == "(" and not after_with:
                pending.append("(")
            elif name and name not in _ORDER:
                label = None if after_with else family(name)
                labels += [label] if label else []
                values.append(WORTH[label] if label else None)
                operand = after_with = False
            else:
                break
        elif sign == ")" and "(" in pending:
            while pending[-1] != "(":
                apply(pending.pop())
            pending.pop()
        elif name in _ORDER:
            while pending and pending[-1] != "(" and _ORDER[pending[-1]] >= _ORDER[name]:
                apply(pending.pop())
            pending.append(name)
            operand, after_with = True, name == "with"
        else:
            break
        at = m.end()
    if operand and pending and pending[-1] != "(":
        pending.pop()  # an operator without its right side
    for op in reversed(pending):
        if op != "(" and len(values) > 1:
            apply(op)
    known = [v for v in values if v is not None]
    return labels, known[0] if known else None


@lru_cache(1)
def automaton():
    import ahocorasick
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG_WORDS: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes) -> dict:
    """What a text carries."""
    words = words_of(text)
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    starts, base, notices, tagged = [], {}, {}, False
    at = blanks = 0  # the places come in ascending order, so blanks are counted once
    longer = set()
    for end, phrase in automaton().iter(line):
        blanks += line.count(" ", at, end)
        at = end
        if phrase in BASE:
            base.setdefault(BASE[phrase], set()).add(end)
            starts.append(blanks - phrase.count(" ") - 1)
        elif phrase == TAG_WORDS:
            tagged = True
        else:
            notices[end - len(phrase)] = phrase  # of phrases that start together, the longest
            longer.add(end)
    labels = {NOTICES[phrase] for phrase in notices.values()}
    # a base phrase that only ends longer notices (a lesser licence) is worth what those are
    worth = [WORTH[x] for x in labels | {x for x, ends in base.items() if ends - longer}]
    if tagged:
        low = text.decode("utf-8", "replace").lower()
        at = low.find(TAG)
        while at >= 0:
            line_end = low.find("\n", at)
            rest = low[at + len(TAG):len(low) if line_end < 0 else line_end]
            found, value = expression(rest.lstrip(" \t:"))
            labels.update(found)
            if value is not None:
                worth.append(value)
            at = low.find(TAG, at + 1)
    every = set(base) | labels
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
            "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(every)), "score": min(worth, default=UNKNOWN)}


SCHEMA = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per document: its id and what ``scan`` finds in its text."""
    rows = docs.select(id_col, "text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = pa.RecordBatch.from_pylist([scan(x or b"") for x in as_bytes(batch.column("text"))], schema=SCHEMA)
                yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=[id_col, *SCHEMA.names])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_words long, n_base long, first_word long, "
                                "last_word long, base_labels string, labels string, score double")


@register("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
