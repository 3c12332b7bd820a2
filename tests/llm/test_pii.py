import random
import re

import pytest
from textlens.llm import pii as P

from .helpers import ODD, documents, prose

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and P.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_against_plain_patterns():
    rng = random.Random(1)
    signs = "0123456789..--  +@@ab(_%)é"
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        assert P.base_spans(text) == brute(text), text
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_posterior_and_best_path_against_all_segmentations():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 7)
        segments = [(i, j, rng.uniform(-2, 3)) for i in range(n) for j in range(i, n) if rng.random() < 0.5]
        every = [[]]

        def grow(at, chosen):
            for k, (i, j, _) in enumerate(segments):
                if i >= at:
                    every.append([*chosen, k])
                    grow(j + 1, [*chosen, k])

        grow(0, [])
        totals = [sum(segments[k][2] for k in x) for x in every]
        z, posterior = P.chart(n, segments)
        assert z == pytest.approx(P._sum(totals))
        for k in range(len(segments)):
            assert posterior[k] == pytest.approx(sum(P.math.exp(t - z) for t, x in zip(totals, every) if k in x))
        assert sum(segments[k][2] for k in P.best_path(n, segments)) == pytest.approx(max(totals))


def corpus(spark):
    rows = [(i, prose(i, 40) + f" +1 ({200 + i}) 555-{1000 + i} " + prose(i + 500, 10) + f" bob.{i}@mail{i}.example.com" + (" version 4.0" if i % 3 else ""))
            for i in range(60)]
    return documents(spark, rows)


def test_field_finds_what_the_patterns_miss_and_leaves_the_rest(spark):
    field = P.fit_field(corpus(spark))
    for text, wanted in [("call +1 (569) 555-6633 4111111111111111 now", ["+1 (569) 555-6633", "4111111111111111"]),
                         ("write to anna [at] mail.example.com today", ["anna [at] mail.example.com"]), ("tel (212) 555-0199 ok", ["(212) 555-0199"])]:
        base, spans = P.spans_of(text, field)
        assert [text[s:e] for _, s, e in sorted(spans, key=lambda x: x[1])] == wanted and set(base) <= set(spans)
    for text in ["version 4.0 of 2021-03-04", "section 1.2.3, page 12", "key 0641917ea4e9feb9cda83477b57ac2654884f485", "4111111111111112", "w12x w3x w4x", prose(1, 300)]:
        assert P.spans_of(text, field) == ([], []), text
    hits = total = 0
    for i in range(300):
        text, truth = P.variants(random.Random(10_000 + i), "some words ", "and more")
        found = set(P.spans_of(text, field)[1])
        hits += len(found & set(truth))
        total += len(truth)
    assert hits >= 0.9 * total


def test_long_addresses_are_found_whole(spark):
    field = P.fit_field(corpus(spark))
    host = "mail." + "verylonghostname" * 3 + ".example.org"
    for address in ("john.smith (at) mail.example.org", "john.smith [AT] mail.example.org", "a.mary.jane.smith (at) mail.dept.example.org",
                    f"john.smith (at) {host}", "john.smith(AT)example.org"):
        for text in (f"write to {address} today", f"write to {address}"):
            spans = P.spans_of(text, field)[1]
            assert [text[s:e] for _, s, e in spans] == [address] and "smith" not in P.redact(text, spans), text


def test_stretches_end_at_white_space_and_do_not_overlap():
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["7", "@", " (AT) ", "x" * 30, "y" * 70, " ", " " * 50, "ab"]) for _ in range(rng.randrange(20)))
        found = P.stretches(text)
        assert all(b < c for (_, b), (c, _) in zip(found, found[1:]))
        assert all(any(a <= m.start() and m.end() <= b for a, b in found) for m in P._TRIGGER.finditer(text))
        assert all(b == len(text) or text[b].isspace() for _, b in found)


def test_operator_on_odd_rows(spark):
    docs = corpus(spark)
    field = P.fit_field(docs)
    odd = documents(spark, list(enumerate(ODD)) + [(7, "a@b.co"), (7, "a@b.co"), (None, "1.2.3.4"), (50, "9" * 20_000), (51, "1 " * 3000), (52, "@" * 5000), (53, "1." * 4000)])
    got = P.find_personal(odd, field).collect()
    assert len(got) == len(ODD) + 7
    assert [r["redacted"] for r in got if r["doc_id"] == 7 and r["spans"]] == ["[email]", "[email]"]
    assert next(r["redacted"] for r in got if r["doc_id"] is None) == "[ip]"
    assert P.find_personal(odd.limit(0), field).count() == 0
    assert isinstance(P.fit_field(documents(spark, [])), P.Field)


def test_redact_overlapping_spans():
    assert P.redact("abcdef", [("email", 1, 4), ("ip", 2, 3), ("card", 3, 5)]) == "a[email]f"
