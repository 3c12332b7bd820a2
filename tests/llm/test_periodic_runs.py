import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from textlens.llm import periodic_runs as P

from .helpers import ODD, documents, prose


def plain_runs(words):
    """All runs by walking each distance, smallest periods first."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > i and e + q - i >= max(24, 3 * q) and (i, e + q) not in seen:
                seen.add((i, e + q))
                out.append((i, e + q - i, q))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_result(words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = [w for i, w in enumerate(words) if i not in gone]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return runs, best, kept


def as_words(numbers):
    return [b"w%d" % x for x in numbers]


def shaped(rng):
    """Texts made of repeats inside repeats, broken here and there."""
    base = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 12))]
    out = []
    for _ in range(rng.randrange(1, 6)):
        part = base * rng.randrange(1, 9)
        if rng.random() < 0.4:
            part[rng.randrange(len(part))] = 99
        out += part + [rng.randrange(60) for _ in range(rng.randrange(0, 20))]
        if rng.random() < 0.3:
            out *= 3
        if rng.random() < 0.5:
            base = base[rng.randrange(len(base)):] + [rng.randrange(60)]
    return out[:900]


def test_runs_match_brute_force():
    rng = random.Random(5)
    seen = 0
    for _ in range(250):
        words = as_words(shaped(rng))
        want = plain_runs(words)
        seen += len(want)
        assert list(map(tuple, P.find_runs(words).tolist())) == want
    assert seen > 300


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 6))
def test_runs_of_any_small_text(numbers, times):
    words = as_words(numbers * times)
    assert list(map(tuple, P.find_runs(words).tolist())) == plain_runs(words)


def test_extensions_match_plain_comparison():
    rng = np.random.default_rng(3)
    for n in (1, 2, 12, 13, 14, 40, 300):
        for letters in (1, 2, 5):
            words = rng.integers(0, letters, n).astype(np.int32)
            ends = P.CommonExtensions(words)
            i, j = np.triu_indices(n, 1)
            pick = rng.permutation(len(i))[:2000]
            i, j = i[pick], j[pick]
            want = []
            for a, b in zip(i.tolist(), j.tolist()):
                k = 0
                while b + k < n and words[a + k] == words[b + k]:
                    k += 1
                want.append(k)
            assert ends.extend(i, j).tolist() == want


def test_any_two_places_meet_in_the_cover():
    for a in range(P.COVER_MOD):
        for b in range(P.COVER_MOD):
            d = P.MEETING[a, b]
            assert (a + d) % P.COVER_MOD in P.COVER and (b + d) % P.COVER_MOD in P.COVER


def test_a_long_text_of_one_word_takes_seconds():
    begin = time.time()
    assert P.find_runs([b"a"] * 300_000).tolist() == [[0, 300_000, 1]]
    assert time.time() - begin < 60


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = [*ODD, *[" ".join(f"w{x}" for x in shaped(rng)) for _ in range(60)], *[prose(i, 200) for i in range(60)]]
    rows = list(enumerate(texts)) + [(3, "again " * 30), (3, "again " * 30), (None, "x y " * 40)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, P.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        if len(words) > 2000:  # one word over and over
            assert len(set(words)) == 1
            runs = [(0, len(words), 1)]
            best, kept = runs[0], words[:1]
        else:
            runs, best, kept = plain_result(words)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(1 for r in want if r[1]) > 20
    assert P.periodic_runs(documents(spark, [])).count() == 0
