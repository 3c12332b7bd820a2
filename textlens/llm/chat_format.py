"""Chat formatting with offset-aligned loss masks.

A turn is rendered as a mark ("### Role:"), its text and an end mark, each on
lines of their own.  Where a text holds a mark ("###" or "</turn>", with any
backslashes before it), one more backslash is put in front: no text can pose
as a mark, and taking one backslash away restores it.  The pre-tokenizer never
joins the end of a turn with the next one, so a rendered conversation can be
encoded in parts that end with a turn; short ones, that is nearly all, are one
part.  A part is encoded once with offsets; the spans of the assistant's texts
are intersected with the tokens' spans by binary search.  A token that reaches
over an end of a text is masked in, and its span clipped to the text.

Rows are range-partitioned by conversation and turn, so a conversation that
holds a large share of the rows is dealt over many tasks.  Equal turn numbers
are ordered by role and text; a null text or role is empty; a null conv_id is
a conversation of its own.  Roles other than system, user and assistant are
written percent-encoded after "=".
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import register, table, written

# Fixed values of the template.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
START, END = "###", "</turn>"
_NAMES = {v: k for k, v in ROLES.items()}
_TURN = re.compile(rf"{START} (\S*):\n(.*?)\n{END}\n", re.S)
_MARK, _ESCAPED = re.compile(rf"{START}|{END}"), re.compile(rf"\\({START}|{END})")
#: Characters after which a part ends with the turn.
PART_CHARS = 200_000


def escape(text: str) -> str:
    """One more backslash before each mark (and so in a run of backslashes before it)."""
    return _MARK.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    """One backslash less before each mark that has one."""
    return _ESCAPED.sub(r"\g<1>", text)


def label(role: str) -> str:
    return ROLES.get(role) or "=" + quote(role, safe="")


def role_of(name: str) -> str:
    return _NAMES.get(name) or unquote(name[1:])


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns (role, text), and the spans of the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START} {label(role)}:\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        turn = f"{head}{body}\n{END}\n"
        out.append(turn)
        at += len(turn)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered part."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not a rendered conversation")
        out.append((role_of(m[1]), unescape(m[2])))
        at = m.end()
    return out


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens touch a span, and the tokens' offsets clipped to it."""
    begin, end = offsets[:, 0], offsets[:, 1]
    inside, clipped = np.zeros(len(offsets), bool), offsets.copy()
    for a, b in spans:
        if a < b:
            lo, hi = np.searchsorted(end, a, side="right"), np.searchsorted(begin, b, side="left")
            inside[lo:hi] = True
            clipped[lo:hi] = np.clip(clipped[lo:hi], a, b)
    return inside, clipped


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def format_chats(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The parts of all conversations: conv_id, the first turn of the part and
    a running number to order them by, its text, token ids, which tokens bear
    loss, and the tokens' offsets (clipped where they bear loss)."""
    vocabulary = vocabulary or vocabulary_path()
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange("conv_id", "turn", F.xxhash64("role", "text")).sortWithinPartitions(*key)

    def lists(parts, kind):
        ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))

    def run(batches):
        encode = tokenizer(vocabulary).encode
        out: list[tuple] = []
        turns: list[tuple[str, str]] = []
        conv = first = last = None
        size = number = 0

        def close():
            text, spans = render(turns)
            found = encode(text, add_special_tokens=False)
            inside, clipped = mask(np.asarray(found.offsets, np.int32).reshape(-1, 2), spans)
            out.append((conv, first, number, text, np.asarray(found.ids, np.int32), inside, clipped[:, 0], clipped[:, 1]))
            turns.clear()

        def batch_of():
            conv, turn, number, text, *tokens = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(number, pa.int64()), pa.array(text, pa.string()),
                 *(lists(x, k) for x, k in zip(tokens, (pa.int32(), pa.bool_(), pa.int32(), pa.int32())))],
                names=["conv_id", "turn", "number", "text", "ids", "loss", "begins", "ends"])

        for batch in batches:
            for c, t, role, text in zip(*(batch.column(k).to_pylist() for k in key)):
                if turns and (c != conv or size > PART_CHARS):
                    close()
                    if len(out) >= 500:
                        yield batch_of()
                if not turns:
                    number = number + 1 if last == (c, t) else 0
                    conv, first, size = c, t, 0
                turns.append((role, text))
                last, size = (c, t), size + len(text)
        if turns:
            close()
        if out:
            yield batch_of()

    return rows.mapInArrow(run, "conv_id long, turn long, number long, text string, ids array<int>, "
                                "loss array<boolean>, begins array<int>, ends array<int>")


def loss_texts(text: str, loss, begins, ends) -> list[str]:
    """The texts under the mask of a part: each run of covered characters, unescaped."""
    on = np.flatnonzero(np.asarray(loss, bool))
    begin, end = np.asarray(begins)[on], np.asarray(ends)[on]
    cut = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return [unescape(text[int(begin[a]):int(end[b - 1])]) for a, b in zip([0, *cut], [*cut, len(on)]) if b > a]


class Digest:
    """What is read back of a conversation, part by part."""

    NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def __init__(self, conv):
        self.conv, self.n, self.chars, self.size = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: str) -> None:
        for role, said in parse(text):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        self.chars += len(loss)
        self.loss.update(loss.encode())
        self.size += len(text)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its parts in order.

    ``parts`` is as ``format_chats`` returns it, sorted within partitions.  A
    partition gives the digests of the conversations that begin and end in it;
    the parts of its first and last one, which may go on in its neighbours,
    are passed on and meet by conversation."""
    digest = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("turn", pa.int64()), ("number", pa.int64()),
                        ("text", pa.string()), ("loss", pa.string())])

    def batch_of(rows, width):
        columns = zip(*rows) if rows else [[]] * width
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names[:width])

    def own(batches):
        passing = True  # is the current conversation passed on? the first one is
        state, held = None, []

        def passed_on():
            return [(state.conv, None, None, None, None, None, *x) for x in held]

        for batch in batches:
            out = []
            marks, begins, ends = (batch.column(k) for k in ("loss", "begins", "ends"))
            at = marks.offsets.to_numpy()
            on, begin, end = np.asarray(marks.values), np.asarray(begins.values), np.asarray(ends.values)
            for k, (c, t, n, text) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "number", "text")))):
                if state is None or c != state.conv:
                    if state:
                        out += passed_on() if passing else [(*state.row(), None, None, None, None)]
                        passing = False
                    state, held = Digest(c), []
                where = slice(at[k], at[k + 1])
                loss = "".join(loss_texts(text, on[where], begin[where], end[where]))
                state.add(text, loss)
                held.append((t, n, text, loss))
                if passing or len(held) > 1:  # also one of several parts, so that no more than one is held
                    passing = True
                    out += passed_on()
                    held = []
            if out:
                yield batch_of(out, len(schema))
        if state and held:
            yield batch_of(passed_on(), len(schema))

    def join(batches):
        state = None
        for batch in batches:
            out = []
            for c, text, loss in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "text", "loss"))):
                if state is None or c != state.conv:
                    if state:
                        out.append(state.row())
                    state = Digest(c)
                state.add(text, loss)
            if out:
                yield batch_of(out, 6)
        if state:
            yield batch_of([state.row()], 6)

    found = written(parts.mapInArrow(own, digest + ", turn long, number long, text string, loss string"), "digests")
    whole = found.where("text is null").select(*Digest.NAMES)
    rest = found.where("text is not null").select("conv_id", "turn", "number", "text", "loss")
    return whole.unionByName(rest.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "number").mapInArrow(join, digest))


@register("op4_chat_format")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(rows.unionByName(extra)))
