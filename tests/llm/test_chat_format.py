import hashlib
import random
import time
from collections import defaultdict

import numpy as np
from textlens.llm import chat_format as C

PIECES = ["###", "</turn>", "\\", " ", "\n", "Assistant:", "a", "é", "日", "\t", "#", "<", "/turn>", "  ", "\n\n", "🙂", "</turn", "ok", "\n</turn>\n", "### User:\n"]


def turns(rng):
    return [(rng.choice(["user", "assistant", "system", "to:ol x", ""]), "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(1, 5))]


def test_round_trip_masks_and_parts():
    rng, tok = random.Random(3), C.tokenizer(C.vocabulary_path())
    for _ in range(1500):
        said = turns(rng)
        text, spans = C.render(said)
        assert C.parse(text) == said
        found = tok.encode(text, add_special_tokens=False)
        inside, clipped = C.mask(np.asarray(found.offsets, np.int64), spans)
        assert "".join(C.loss_texts(text, inside, clipped[:, 0], clipped[:, 1])) == "".join(t for r, t in said if r == "assistant")
        for on, (a, b) in zip(inside, found.offsets):  # the mask against every pair of spans
            assert on == any(a < e and s < b for s, e in spans)
        assert [i for t in said for i in tok.encode(C.render([t])[0], add_special_tokens=False).ids] == found.ids


def expect(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for c, own in by.items():
        own = sorted(((t is not None, t or 0, r or "", x or "") for _, t, r, x in own))
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_against_brute_force(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for c in range(40):
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns(rng))]
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (51, 0, None, "x"), (51, 0, "assistant", "b"), (51, 0, "assistant", "b"), (None, 0, "assistant", "n"),
             (52, 0, "assistant", "long " * 50_000), (53, None, "user", "z")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} " + "x" * 50) for t in range(3000)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    sizes = {}
    for limit in (200_000, 2_000):
        monkeypatch.setattr(C, "PART_CHARS", limit)
        parts = C.format_chats(frame.repartition(5))
        got = C.read_back(parts).collect()
        assert {r[0]: tuple(r[1:5]) for r in got} == expect(rows)
        sizes[limit] = sorted((str(r[0]), r[5]) for r in got)
    assert sizes[200_000] == sizes[2_000]
    assert C.read_back(C.format_chats(frame.limit(0))).count() == 0


def test_escapes_take_linear_time():
    took = []
    for n in (100_000, 1_600_000):
        text = "\\" * n + "###" + "\\" * n
        begin = time.process_time()
        assert C.unescape(C.escape(text)) == text
        took.append(time.process_time() - begin)
    assert took[1] < 80 * took[0] + 0.5
