import random

import numpy as np
from textlens.llm import decontaminate as D

from .helpers import ODD, documents, prose


def distance(item, text):
    """Fewest edits between ``item`` and any part of ``text``."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (np.frombuffer(text, np.uint8) != c))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_find_against_all_alignments():
    rng = random.Random(5)
    items = [sentence(i, rng.randrange(6, 50)).encode() for i in range(25)]
    index = D.Index(list(range(25)), items)
    for case in range(150):
        k = case % 25
        item = bytearray(items[k])
        for _ in range(rng.randrange(0, int(len(item) * 0.09) + 2)):
            p, o = rng.randrange(len(item)), rng.random()
            if o < 0.4:
                item[p] = rng.choice(b"abcxyz")
            elif o < 0.7:
                item.insert(p, rng.choice(b"abcxyz"))
            elif len(item) > 1:
                del item[p]
        text = sentence(900 + case, 20).encode() + b" " + bytes(item) + b" " + sentence(300 + case, 20).encode()
        line = D.folded(text)[0].tobytes()
        found = {i: (s, e, edits) for i, s, e, edits in index.find(text)}
        for i in range(25):
            c = index.items[i].tobytes()
            least = distance(c, line)
            assert (i in found) == (least <= index.budget[i]), (case, i, least, index.budget[i])
            if i in found:
                s, e, edits = found[i]
                assert edits == least == distance(c, D.folded(text[s:e])[0].tobytes())


def test_case_marks_white_space_and_spans(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog, again and again."), (2, None), (3, " .,!"), (4, "Two words"), (5, "été là-bas où")], "item_id long, text string")
    docs = documents(spark, [
        (1, "é THE%%% quick***  brown\nfox jumps over the lazy dog again AND again!!! tail"), (2, "clean text of two word"), (3, "has two  WORDS. here"),
        (4, "the quick brown fox jumps"), (5, "a été là bas où"), *[(100 + i, t) for i, t in enumerate(ODD)]])
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"]) for r in D.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 4), (5, 5)}
    assert got[3, 4] == (4, 14) and got[5, 5] == (2, 15)
    kept = D.decontaminate(docs, bench)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {2, 4, *(100 + i for i in range(len(ODD)))}


def test_blocks_repeats_and_empty_tables(spark, monkeypatch):
    bench = spark.createDataFrame([(i, sentence(i, 20)) for i in range(12)], "item_id long, text string")
    docs = documents(spark, [(1, prose(1, 50) + " " + sentence(3, 20) + " " + sentence(3, 20)), (1, sentence(4, 20)), (None, sentence(5, 20))])
    whole = sorted(map(tuple, D.leaks(docs, bench).collect()), key=str)
    monkeypatch.setattr(D, "BLOCK_BYTES", 900)
    assert sorted(map(tuple, D.leaks(docs, bench).collect()), key=str) == whole and len(whole) == 4
    assert D.decontaminate(docs, bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.decontaminate(docs, bench.limit(0)).count() == 3
    assert D.leaks(docs.limit(0), bench).count() == 0


def test_parts_of_long_items():
    long, short = sentence(70, 59).encode(), sentence(71, 45).encode()
    passage = sentence(72, 2000).encode()
    index = D.Index([1, 2, 3], [long, short, passage])
    before, after = sentence(73, 30).encode() + b" ", b" " + sentence(74, 30).encode()

    def found(words):
        text = before + b" ".join(words) + after
        return [(i, D.folded(text[s:e])[0].tobytes(), edits) for i, s, e, edits in index.find(text)]

    words = long.split()
    assert found(words) == [(1, long, 0)]
    for part in (words[:-9], words[9:]):  # windows may take in a word beside the quoted part, within their budget
        (i, quoted, edits), = found(part)
        assert i == 1 and edits <= 15 and len(quoted.split()) >= D.WINDOW
    (i, quoted, edits), = found(passage.split()[333:633])
    assert i == 3 and edits <= 15 and len(quoted.split()) >= 300 - 2 * D.STEP
    changed = passage.split()[333:633]
    changed[100] = b"changed"
    assert {i for i, *_ in found(changed)} == {3}
    assert all(found(passage.split()[a:a + 49]) for a in range(40, 60)) and not found(passage.split()[43:73])
    assert not found(short.split()[:38]) and found(short.split()) == [(2, short, 0)]
    han = "".join(chr(0x4E00 + (i * 7919) % 5000) for i in range(600)).encode()
    assert [(i, e - s > 600) for i, s, e, _ in D.Index([4], [han]).find(before + han[300:1200] + after)] == [(4, True)]
