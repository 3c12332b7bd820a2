"""Personal data: base patterns, and a semi-Markov conditional random field.

The base patterns (e-mail, IP, card, phone) give the spans that always count.
What they miss (a number that runs into the next one, a phone number without
its country code, an address with "(at)") is left to a semi-Markov conditional
random field.  It reads the stretches of a text around digits and "@" signs;
elsewhere no span can start.  Segments of up to ``LONGEST`` tokens are scored
as a whole (the shape of their digits, separators, check digits, what stands
around them), and dynamic programming over the segments' ends chooses
boundaries and kinds together; a segment is reported if its posterior
probability, by the forward and backward sums, reaches ``SURE``.  Segments
never overlap base spans.

The field is trained on the given corpus: stretches of a bounded sample of
documents, with the base spans as their truth, and copies of them in which
personal data of known extent has been written in other ways or set beside
look-alikes (dates, versions, order numbers).

Null texts are empty.  Digits are ASCII digits.  Spans are in code points, the
end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import register, slices, table

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24
SURE = 0.95
AROUND = 40
#: Documents whose stretches the field may be trained on, and how many stretches.
SAMPLE_DOCS, SAMPLE_STRETCHES = 400, 300

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[] ?[Aa][Tt] ?[)\]]")
_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\S")
_AT = re.compile(r" ?[(\[] ?at ?[)\]] ?|@", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append(("ip", start, start + size))
            start += size + 1
    for m in _NUMBER.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text in which a span may lie; they end at white space
    and do not overlap."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() - out[-1][1] <= AROUND:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    found: list[tuple[int, int]] = []
    for a, b in out:
        done = found[-1][1] if found else 0
        a, b = max(done, a - AROUND), max(done, min(len(text), b + AROUND))
        while a > done and not text[a - 1].isspace():
            a -= 1
        while done < b < len(text) and not text[b].isspace():
            b += 1
        if found and a == done:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return found


def candidates(text: str, a: int, b: int, taken: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, str]]]:
    """The tokens of a stretch, and (first token, last token, kind) of each
    segment that could be of the kind at all."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
    blocked = [any(s < y and x < e for x, y in taken) for s, e in tokens] if taken else [False] * len(tokens)
    words = [text[s:e] for s, e in tokens]
    is_at = [w == "@" or w in ")]" and k > 1 and words[k - 1].lower() == "at" and words[k - 2] in "([" for k, w in enumerate(words)]
    marks = [k for k, x in enumerate(is_at) if x]
    out, coming = [], 0
    for i, (s, e) in enumerate(tokens):
        first = text[s]
        while coming < len(marks) and marks[coming] < i:
            coming += 1
        reach = LONGEST if coming < len(marks) and marks[coming] < i + LONGEST else 9
        if blocked[i] or not (first.isalnum() or first in "+("):
            continue
        digits, ats, other = 0, 0, False
        for j in range(i, min(i + LONGEST, len(tokens))):
            x, y = tokens[j]
            if blocked[j] or j > i and x - tokens[j - 1][1] > 1 or "\n" in text[tokens[j - 1][1]:x]:
                break
            token = words[j]
            ats += is_at[j] and (token == "@" or j > i + 1)
            if token.isascii() and token.isdigit():
                digits += y - x
                if not other and not ats:
                    if 7 <= digits <= 15:
                        out.append((i, j, "phone"))
                    if 13 <= digits <= 19 and first.isdigit():
                        out.append((i, j, "card"))
                    if first.isdigit() and j - i in (6,) and digits <= 12:
                        out.append((i, j, "ip"))
            elif token.isalpha():
                other = True
            elif token not in "+().-/_%[]@":
                break
            if other and not digits and j - i >= reach:
                break
            if ats and first.isalnum() and token.isalpha() and j > i + 2:
                out.append((i, j, "email"))
    return tokens, out


def features(text: str, s: int, e: int, kind: str) -> list[str]:
    """What is said of a whole segment."""
    seg = text[s:e]
    digits = "".join(c for c in seg if "0" <= c <= "9")
    before, after = text[s - 1:s], text[e:e + 1]
    out = [f"{kind}", f"{kind}<{'w' if before.isalnum() else before if before in '+-.@_/=#' else ' '}",
           f"{kind}>{'w' if after.isalnum() else after if after in '-@_/=%' else '.' if after == '.' and text[e + 1:e + 2].isalnum() else ' '}"]
    if kind == "email":
        local, *rest = _AT.split(seg, maxsplit=1)
        domain = rest[0] if rest else ""
        top = domain.rpartition(".")[2]
        out += [f"email local {bool(re.fullmatch('[A-Za-z0-9._%+-]+', local))}", f"email domain {bool(_DOMAIN.fullmatch(domain))}",
                f"email top {min(len(top), 5) if top.isalpha() else 0}", f"email blanks {min(seg.count(' '), 3)}"]
        return out
    shape = re.sub("[0-9]+", lambda m: str(len(m[0])), seg)
    groups = re.findall("[0-9]+", seg)
    seps = "".join(sorted({c for c in seg if not c.isdigit()}))
    out += [f"{kind} shape {shape}", f"{kind} digits {len(digits)}", f"{kind} groups {min(len(groups), 6)}", f"{kind} seps {seps}",
            f"{kind} luhn {luhn(digits)}", f"{kind} whole {len(groups) == 1}"]
    if kind == "phone":
        out += [f"phone plus {seg[0] == '+'}", f"phone area {bool(re.search('[(][0-9]{2,5}[)]', seg))}",
                f"phone tail {len(groups[-1])}", f"phone balanced {seg.count('(') == seg.count(')')}"]
    elif kind == "card":
        out.append(f"card fours {all(len(g) == 4 for g in groups[:-1])} {len(seps)}")
    else:
        out.append(f"ip small {len(groups) == 4 and all(map(_small, groups))}")
    return out


def _sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def chart(n: int, segments: list[tuple[int, int, float]]) -> tuple[float, list[float]]:
    """Log of the sum over all segmentations of ``n`` tokens (a token outside
    of segments scores 0), and each segment's posterior probability."""
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(segments):
        ending[j + 1].append(k)
        starting[i].append(k)
    ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for t in range(1, n + 1):
        ahead[t] = _sum([ahead[t - 1], *(ahead[segments[k][0]] + segments[k][2] for k in ending[t])]) if ending[t] else ahead[t - 1]
    for t in range(n - 1, -1, -1):
        back[t] = _sum([back[t + 1], *(back[segments[k][1] + 1] + segments[k][2] for k in starting[t])]) if starting[t] else back[t + 1]
    return ahead[n], [math.exp(min(0.0, ahead[i] + score + back[j + 1] - ahead[n])) for i, j, score in segments]


def best_path(n: int, segments: list[tuple[int, int, float]]) -> list[int]:
    """The segments of the best segmentation (Viterbi over segment ends)."""
    best, choice = [0.0] * (n + 1), [-1] * (n + 1)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j, _) in enumerate(segments):
        ending[j + 1].append(k)
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for k in ending[t]:
            v = best[segments[k][0]] + segments[k][2]
            if v > best[t]:
                best[t], choice[t] = v, k
    out, t = [], n
    while t > 0:
        k = choice[t]
        if k < 0:
            t -= 1
        else:
            out.append(k)
            t = segments[k][0]
    return out[::-1]


class Field:
    """The weights of the whole-span features."""

    def __init__(self):
        self.weights: dict[str, float] = {}

    def score(self, names: list[str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in names) - 1.0

    def train(self, examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 6, rate: float = 0.5, decay: float = 1e-4) -> Field:
        """Likelihood ascent with a step per stretch (text, its true spans)."""
        prepared = []
        for text, spans in examples:
            tokens, found = candidates(text, 0, len(text), [])
            truth = set(spans)
            rows = [(i, j, features(text, tokens[i][0], tokens[j][1], kind), (kind, tokens[i][0], tokens[j][1]) in truth) for i, j, kind in found]
            if rows:
                prepared.append((len(tokens), rows))
        order = random.Random(5)
        squares: dict[str, float] = {}
        for _ in range(rounds):
            order.shuffle(prepared)
            for n, rows in prepared:
                _, posterior = chart(n, [(i, j, self.score(f)) for i, j, f, _ in rows])
                slope: dict[str, float] = {}
                for (_, _, names, true), p in zip(rows, posterior):
                    if abs(true - p) > 1e-4:
                        for f in names:
                            slope[f] = slope.get(f, 0.0) + true - p
                for f, g in slope.items():
                    g -= decay * self.weights.get(f, 0.0)
                    squares[f] = squares.get(f, 1e-8) + g * g
                    self.weights[f] = self.weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
        return self

    def find(self, text: str, base: list[tuple[str, int, int]], sure: float = SURE) -> list[tuple[str, int, int]]:
        """Spans beside the base spans."""
        out = []
        for a, b in stretches(text):
            taken = [(s, e) for _, s, e in base if s < b and a < e]
            tokens, found = candidates(text, a, b, taken)
            if not found:
                continue
            segments = [(i, j, self.score(features(text, tokens[i][0], tokens[j][1], kind))) for i, j, kind in found]
            if max(s for _, _, s in segments) <= 0:
                continue
            _, posterior = chart(len(tokens), segments)
            out += [(found[k][2], tokens[found[k][0]][0], tokens[found[k][1]][1])
                    for k in best_path(len(tokens), segments) if posterior[k] >= sure]
        return sorted(set(out) - set(base), key=lambda x: (KINDS.index(x[0]), x[1]))


def variants(rng: random.Random, left: str, right: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A stretch with invented personal data or look-alikes between two contexts."""
    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(body[i:i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        area, mid, end = digits(3), digits(3), digits(4)
        return rng.choice([f"({area}) {mid}-{end}", f"+{rng.randrange(1, 99)} ({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"+{rng.randrange(1, 99)}-{area}-{mid}-{end}",
                           f"+{rng.randrange(1, 99)} {area} {mid} {end}", f"({area}) {mid} {end}"])

    def email() -> str:
        name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) + rng.choice(["", ".", "_"]) + digits(rng.randrange(3))
        name = name.rstrip("._") or "a"
        for _ in range(rng.choice([0, 0, 1, 2])):
            name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 9))) + rng.choice(".._-") + name
        host = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) + "." + rng.choice(["com", "org", "net", "de", "example.com", "dept.example.org"])
        return name + rng.choice([" (at) ", "(at)", " [at] ", "[at]", " (AT) ", "[AT]"]) + host

    def ip() -> str:
        return ".".join(str(rng.randrange(256)) for _ in range(4))

    def nothing() -> str:
        wrong = digits(16)
        wrong = wrong if not luhn(wrong) else wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
        return rng.choice([f"{1900 + rng.randrange(130)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}", f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}", wrong,
                           digits(rng.randrange(1, 13)), f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(3)}.{300 + rng.randrange(600)}.{digits(3)}.{digits(2)}",
                           f"no. {digits(rng.randrange(7, 13))}", f"{digits(3)},{digits(3)}.{digits(2)}", f"{digits(8)}-{digits(6)}", f"{digits(4)}-{digits(4)}",
                           f"id={digits(10)}", hashlib.md5(digits(8).encode()).hexdigest(), f"{digits(4)} {digits(4)} {digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}"])

    makers = {"card": card, "phone": phone, "email": email, "ip": ip, "": nothing}
    text, spans = left, []
    for kind in rng.choices(list(makers), weights=[2, 3, 1, 1, 4], k=rng.choice([1, 1, 2])):
        made = makers[kind]()
        text += " " if text and not text[-1].isspace() else ""
        if kind:
            spans.append((kind, len(text), len(text) + len(made)))
        text += made + rng.choice(["", "", ".", ",", "%%%", "***"])
    return text + " " + right, spans


def fit_field(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_stretches: int = SAMPLE_STRETCHES) -> Field:
    """Train on the first stretch of at most ``sample_docs`` documents that
    have any (the stretches with the smallest hashes) and on variants of them."""
    place = F.regexp_instr("text", F.lit("[0-9@]"))
    pieces = docs.select("text", place.alias("at")).where("at > 0")
    pieces = pieces.select(F.expr("substring(text, greatest(at - 60, 1), 220)").alias("piece")).distinct()
    real = sorted(r["piece"] for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(sample_docs).collect())
    rng = random.Random(11)
    rng.shuffle(real)
    real = real[:sample_stretches]
    examples = [(p, [s for s in base_spans(p)]) for p in real]
    clean = [re.sub(r"\S*[0-9@]\S*", "", p) for p in real] or [""]
    for _ in range(3 * sample_stretches):
        c = rng.choice(clean)
        cut = rng.randrange(len(c) + 1)
        while 0 < cut < len(c) and not c[cut - 1].isspace():
            cut -= 1
        examples.append(variants(rng, c[max(0, cut - 30):cut], c[cut:cut + 30]))
    return Field().train(examples)


def spans_of(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans of a text, and all spans, each by kind and start."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + field.find(text, base), key=lambda x: (KINDS.index(x[0]), x[1]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_personal(docs: DataFrame, field: Field, id_col: str = "doc_id") -> DataFrame:
    """(id, base, spans, redacted) of each document: both lists as arrays of
    (kind, start, end), and the text with all spans masked."""
    rows = docs.select(F.col(id_col).alias("doc_id"), "text")
    shared = rows.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                found = [spans_of(x, shared.value) for x in texts]
                named = [[[dict(zip(("kind", "start", "end"), s)) for s in both[k]] for both in found] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(named[0], span), pa.array(named[1], span),
                     pa.array([redact(x, both[1]) for x, both in zip(texts, found)], pa.string())], names=["doc_id", "base", "spans", "redacted"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, base {kind}, spans {kind}, redacted string")


@register("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal(docs, fit_field(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
