r"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with character offsets, and the
sorted spans of its turns are intersected with the token spans by binary search.
A turn reads ``### role:``, a line end, the escaped text, ``</turn>``, a line end.
Escaping puts a backslash before each backslash, ``###`` and ``</turn>``; roles
also escape a colon and a line end. ``parse`` reverses it.

A conversation of more than PART_TURNS turns is rendered and encoded in parts
that end with a turn, dealt by ranges of turns, so no task has to hold or sort a
conversation of unbounded length. Tokens are those of the whole, since the tokenizer
splits its input between the end of a turn and the start of the next; each such
place is asked for it, and a tokenizer that does not is refused. ``whole`` joins parts.

Defined cases: null text and null role are empty; turns are ordered by turn, then
role, then text, nulls first, and repeated rows are repeated turns; rows without
a conversation id are one conversation with a null id; empty texts are turns
without tokens under the mask; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm.runtime import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PART_TURNS = 256
#: Ids of long conversations that may go to every task.
BROADCAST_ROWS = 400_000
OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")
_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:|\n)|[^\\:\n])*):\n((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*)</turn>\n")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The formatted text, and the start and end of each turn's escaped text."""
    out, at, lo, hi = [], 0, [], []
    for role, text in turns:
        head = OPEN + _ROLE.sub(lambda m: "\\" + m[0], role) + MIDDLE
        body = escape(text)
        lo.append(at + len(head))
        hi.append(at + len(head) + len(body))
        out += (head, body, CLOSE)
        at = hi[-1] + len(CLOSE)
    return "".join(out), np.array(lo, np.int64), np.array(hi, np.int64)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def mask(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens [a, b) reach into a span [lo, hi), and the text of each span that they cover."""
    on = np.searchsorted(lo, b, "left") - np.searchsorted(hi, a, "right") > 0
    first = np.searchsorted(b, lo, "right")
    last = np.searchsorted(a, hi, "left") - 1
    spans = [(max(int(x), int(a[f])), min(int(y), int(b[e]))) for x, y, f, e in zip(lo, hi, first, last, strict=True) if x < y and f <= e]
    return on, spans


def load(tokenizer: bytes):
    from tokenizers import Tokenizer

    own = Tokenizer.from_buffer(tokenizer)
    own.encode_special_tokens = True  # control strings of the vocabulary are ordinary text here
    return own


def splits(tokenizer, role: str) -> bool:
    """Whether the input is always cut between a turn's end and a next turn of that role: the line end there is a piece of its own.

    Pieces are made before merging and see no further than a run of white space, and that of the line end begins and ends with it.
    """
    head = OPEN + _ROLE.sub(lambda m: "\\" + m[0], role) + MIDDLE
    at = len("x") + len(CLOSE)
    made = tokenizer.pre_tokenizer.pre_tokenize_str("x" + CLOSE + head) if tokenizer.pre_tokenizer else []
    return any(a == at - 1 and b == at for _, (a, b) in made)


SCHEMA = "part long, n_turns int, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_spans array<long>"
FIELDS = [("part", pa.int64()), ("n_turns", pa.int32()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())), ("loss_spans", pa.list_(pa.int64()))]


def format_chats(chats: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each conversation and part: SCHEMA after the id.

    loss_spans: flat starts and ends in ``formatted`` of the text under the mask.
    A conversation of at most PART_TURNS turns is one row, with part 0.
    """
    with open(tokenizer, "rb") as f:
        held = chats.sparkSession.sparkContext.broadcast(f.read())
    rows = chats.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    long = materialise(rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > PART_TURNS).select(F.col("id").alias("long")), "chat-long")
    if long.isEmpty():
        short = rows
    else:
        side = F.broadcast(long) if long.count() <= BROADCAST_ROWS else long
        short = rows.join(side, F.col("id").eqNullSafe(F.col("long")), "left_anti")
        rest = rows.join(side, F.col("id").eqNullSafe(F.col("long")), "left_semi")
        # ranges of turns; of long texts only the beginnings are sampled for their bounds
        rest = rest.repartitionByRange("id", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions("id", "turn", "role", "text")
    short = short.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    kind = chats.schema[id_col].dataType.simpleString()

    most = PART_TURNS

    def encode(batches, parts: bool):
        own = load(held.value)
        key, turns, known = (), [], set()
        done: list = []
        first = (TaskContext.get().partitionId() << 32) + 1 if parts else 0

        def close():
            text, lo, hi = render([(r, t) for r, t in turns])
            wanted = np.array([r == learn for r, _ in turns])
            got = own.encode(text, add_special_tokens=False)
            spans = np.fromiter(chain.from_iterable(got.offsets), np.int64).reshape(-1, 2)
            on, loss = mask(spans[:, 0], spans[:, 1], lo[wanted], hi[wanted])
            done.append((*key, first, len(turns), text, np.array(got.ids, np.int32), on, [x for s in loss for x in s]))

        def flush(kind):
            cols = list(zip(*done, strict=True)) or [[]] * 7
            names = [id_col, *(n for n, _ in FIELDS)]
            arrays = [pa.array(c, t) for c, t in zip(cols, [kind, *(t for _, t in FIELDS)], strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if (i,) != key or (parts and len(turns) == most):
                    if turns:
                        close()
                        first += parts
                    key, turns = (i,), []
                    if len(done) >= 256:
                        yield flush(kind)
                if parts and not turns and role not in known:
                    if not splits(own, role):
                        raise ValueError("this tokenizer does not split its input between turns, so conversations cannot be encoded in parts")
                    known.add(role)
                turns.append((role, text))
        if turns:
            close()
            yield flush(kind)

    schema = f"`{id_col}` {kind}, {SCHEMA}"
    out = short.mapInArrow(lambda b: encode(b, False), schema)
    return out if long.isEmpty() else out.unionByName(rest.mapInArrow(lambda b: encode(b, True), schema))


def whole(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """One row a conversation of all its parts, offsets counted through; a conversation has to fit a row (2 GB)."""
    field = lambda n: F.transform("p", lambda r: r[n])
    rows = formatted.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("part", "n_turns", "formatted", "token_ids", "loss_mask", "loss_spans"))).alias("p"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("s"))
    spans = F.aggregate("p", none, lambda a, r: F.struct((a["at"] + F.length(r["formatted"])).alias("at"), F.concat(a["s"], F.transform(r["loss_spans"], lambda x: x + a["at"])).alias("s")), lambda a: a["s"])
    turns = F.aggregate("p", F.lit(0), lambda a, r: a + r["n_turns"])
    flat = lambda n: F.flatten(field(n)).alias(n)
    return rows.select(id_col, turns.alias("n_turns"), F.array_join(field("formatted"), "").alias("formatted"), flat("token_ids"), flat("loss_mask"), spans.alias("loss_spans"))


def digest(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from formatted rows, for each conversation.

    Parts pass in order and only hash states are kept, so memory does not grow
    with a conversation.
    """
    kind = formatted.schema[id_col].dataType.simpleString()
    rows = formatted.select(id_col, "part", "formatted", "loss_spans").repartition(id_col).sortWithinPartitions(id_col, "part")

    def run(batches):
        key, started = None, False
        n = chars = size = 0
        turns = loss = None
        names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            t = batch.schema.field(0).type
            done = []
            for i, text, spans in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if not started or i != key:
                    if started:
                        done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    key, started, n, chars, size, turns, loss = i, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    said = unescape(text[a:b])
                    loss.update(said.encode())
                    chars += len(said)
                size += len(text)
            yield _batch(done, names, t)
        if started:
            yield _batch([(key, n, turns.hexdigest(), chars, loss.hexdigest(), size)], names, t)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows, names, kind):
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
