"""SentencePiece segmentation sampled by forward filtering and backward sampling.

A text is a lattice of vocabulary pieces. No piece goes from a character to a
space (a model with such pieces is refused), so the lattice falls apart before each run of spaces; equal parts are
filtered forward once. Then every occurrence is sampled backward from its end,
with random numbers that are a hash of the row's key, the part's place in the
row and the step: the same key, text and seed give the same pieces anywhere.

Piece weights are those of the model; a BPE model has ranks instead, and a piece
of rank r weighs 1 / (r + 2), as words by rank do. ``alpha`` is the inverse
temperature. Characters without a piece, and a literal U+2581, become byte
pieces, so decoding gives back any text.

Defined cases: null or empty text has no pieces and decodes to empty; a null key
counts as the empty text; equal rows get equal pieces; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm import textbytes as tb

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = 0x2581, 0x110000
#: Bytes of text worked on at a time, and characters of filtered parts that a process keeps.
CHUNK, KEPT = 1 << 18, 500_000
#: Bytes of an array of strings that 32-bit offsets hold.
MOST_BYTES = (1 << 31) - 1


class Vocabulary:
    """The pieces of a SentencePiece model as arrays."""

    def __init__(self, path: str = MODEL, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        said = [sp.id_to_piece(i) for i in range(n)]
        self.n = n
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        normal = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)) and said[i]]
        score = np.array([sp.get_score(i) for i in normal])
        ranked = len(score) and score.min() < -100  # log probabilities are not that low
        weight = -np.log(np.minimum(-score, n) + 2) if ranked else score
        self.longest = max((len(said[i]) for i in normal), default=1)
        crossing = [said[i] for i in normal if "\u2581" in said[i].lstrip("\u2581")]
        if crossing:
            raise ValueError(f"pieces that go from a character to a space, as {crossing[0]!r}, do not fit parts that begin with spaces")
        points = [np.array([ord(c) for c in said[i]]) for i in normal]
        cut = np.concatenate(([0], np.cumsum([len(p) for p in points])))
        s = _prefix(np.concatenate(points)) if points else np.zeros(1, np.uint64)
        h = tb.span_hash(s, cut[:-1], cut[1:])
        order = np.argsort(h)
        self.hash, self.id, self.weight = h[order], np.array(normal)[order], alpha * weight[order]
        # where hashes with the same first 20 bits begin, and the most of these
        self.slot = np.searchsorted(self.hash, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.slot[-1] = len(self.hash)
        self.maybe = np.diff(self.slot) > 0
        self.most = int(np.diff(self.slot).max())
        self.lengths = np.unique([len(p) for p in points])
        self.fallback = alpha * (weight.min() - 5 if len(weight) else -10.0)
        text = [b""] * n
        for i in normal:
            text[i] = said[i].replace("\u2581", " ").encode()
        for b, i in enumerate(self.byte):
            text[i] = bytes([b])
        self.size = np.array([len(t) for t in text])
        self.at = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.bytes = np.frombuffer(b"".join(text), np.uint8)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their places in id and weight."""
        at = (h >> np.uint64(44)).astype(np.int64)
        some = np.flatnonzero(self.maybe[at])
        k, h = self.slot[at[some]], h[some]
        ok = self.hash[k] == h if len(some) else np.zeros(0, bool)
        for _ in range(self.most - 1):
            k = np.where(ok, k, np.minimum(k + 1, len(self.hash) - 1))
            ok = self.hash[k] == h if len(some) else ok
        return some[ok], k[ok]


def _prefix(points: np.ndarray) -> np.ndarray:
    s = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(tb.mix(points.astype(np.uint64) + np.uint64(99)) * tb._pow(len(points) + 1)[0][: len(points)], out=s[1:])
    return s


def _points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with a space in front of every row that is not empty; row offsets."""
    raw = data.tobytes()
    cp = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
    cp[cp == SPACE] = LITERAL
    cp[cp == 32] = SPACE
    full = np.diff(chars) > 0
    out = np.insert(cp, chars[:-1][full], SPACE)
    return out, chars + np.concatenate(([0], np.cumsum(full)))


def _arcs(cp: np.ndarray, cut: np.ndarray, voc: Vocabulary):
    """Arcs of the parts' lattices, by end: start, end, token (n + code point: fallback), weight."""
    s = _prefix(cp)
    size = np.diff(cut)
    end = np.repeat(cut[1:], size)
    starts, ends, tokens, weights = [], [], [], []
    at = np.arange(len(cp))
    for n in voc.lengths:
        own = at[at + n <= end]
        some, k = voc.find(tb.span_hash(s, own, own + n))
        starts.append(own[some])
        ends.append(own[some] + n)
        tokens.append(voc.id[k])
        weights.append(voc.weight[k])
        if n == 1:
            bare = np.ones(len(cp), bool)
            bare[own[some]] = False
            bare = np.flatnonzero(bare)
            starts.append(bare)
            ends.append(bare + 1)
            tokens.append(voc.n + cp[bare])
            weights.append(np.full(len(bare), voc.fallback))
    # an end is known by the place of its last character: ends of parts are not starts of the next
    hi = [e - 1 for e in ends]
    depth = at - np.repeat(cut[:-1], size)
    count, rank = np.zeros(len(cp), np.int64), []
    for e in hi:  # no two arcs of one length end at a place
        rank.append(count[e])
        count[e] += 1
    by_depth = np.argsort(depth.astype(np.int16) if len(depth) and depth.max() < 1 << 15 else depth, kind="stable")
    first = np.empty(len(cp), np.int64)
    first[by_depth] = np.cumsum(count[by_depth]) - count[by_depth]
    to = np.concatenate([first[e] + r for e, r in zip(hi, rank, strict=True)])
    out = []
    for x in (starts, hi, tokens, weights):
        x = np.concatenate(x)
        y = np.empty(len(x), x.dtype)
        y[to] = x
        out.append(y)
    return *out, depth


def _filter(cp: np.ndarray, cut: np.ndarray, voc: Vocabulary):
    """For each place, the arcs that end there and the cumulated chances of taking them backward."""
    lo, hi, token, weight, depth = _arcs(cp, cut, voc)
    new = np.ones(len(hi), bool)
    new[1:] = hi[1:] != hi[:-1]
    first = np.flatnonzero(new)
    nodes = hi[first]
    count = np.diff(np.append(first, len(hi)))
    alpha = np.zeros(len(cp))
    chance = np.empty(len(hi))
    bounds = np.searchsorted(depth[nodes], np.arange(int(depth.max(initial=-1)) + 2))
    inside = depth[lo] > 0
    for t in range(len(bounds) - 1):
        a, b = bounds[t], bounds[t + 1]
        x, y = first[a], first[b] if b < len(first) else len(hi)
        v = weight[x:y] + np.where(inside[x:y], alpha[lo[x:y] - 1], 0.0)
        f = first[a:b] - x
        top = np.maximum.reduceat(v, f)
        p = np.exp(v - np.repeat(top, count[a:b]))
        total = np.add.reduceat(p, f)
        alpha[nodes[a:b]] = top + np.log(total)
        chance[x:y] = p / np.repeat(total, count[a:b])
    run = chance  # cumulated within each place alone, so that it does not depend on what else is in the batch
    more = first[count > 1]
    left = count[count > 1] - 1
    while len(more):
        run[more + 1] += run[more]
        more, left = more + 1, left - 1
        more, left = more[left > 0], left[left > 0]
    run[first + count - 1] = 2.0  # the last arc takes what rounding leaves
    of = np.zeros(len(cp), np.int64)
    of[nodes] = first
    return lo, token, run, of


class Parts:
    """Filtered parts by hash; forgets all of them when they are too many."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self._clear()

    def _clear(self):
        self.hash, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lo, self.token, self.of = (np.zeros(0, np.int32) for _ in range(3))
        self.run = np.zeros(0)

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        return k, self.hash[k] == h if len(self.hash) else np.zeros(len(h), bool)

    def starts(self, h: np.ndarray, cp: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where the parts with these distinct hashes begin in this store; first: where in cp."""
        if len(self.of) > KEPT:
            self._clear()
        new = np.flatnonzero(~self._place(h)[1])
        if len(new):
            cut = np.concatenate(([0], np.cumsum(size[new])))
            at = np.repeat(first[new] - cut[:-1], size[new]) + np.arange(cut[-1])
            lo, token, run, of = _filter(cp[at], cut, self.voc)
            chars, arcs = len(self.of), len(self.lo)
            self.lo = np.append(self.lo, (lo + chars).astype(np.int32))
            self.token = np.append(self.token, token.astype(np.int32))
            self.run = np.append(self.run, run)
            self.of = np.append(self.of, (of + arcs).astype(np.int32))
            known = np.append(self.hash, h[new])
            order = np.argsort(known, kind="stable")
            self.hash, self.begin = known[order], np.append(self.begin, cut[:-1] + chars)[order]
        return self.begin[self._place(h)[0]]


def sample(data: np.ndarray, off: np.ndarray, keys: np.ndarray, parts: Parts, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows, one after another, and their rows + 1 offsets."""
    ids, sizes = [np.zeros(0, np.int64)], []
    for a, b in tb.pieces(off, CHUNK):
        got, size = _sample(data[off[a] : off[b]], off[a : b + 1] - off[a], keys[a:b], parts, seed)
        ids.append(got)
        sizes.append(size)
    return np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes])))).astype(np.int64)


def _sample(data, off, keys, parts, seed):
    cp, cut = _points(data, off)
    rows = len(off) - 1
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    begin = cp == SPACE
    begin[1:] &= cp[:-1] != SPACE
    begin[cut[:-1][np.diff(cut) > 0]] = True
    start = np.flatnonzero(begin)
    stop = np.append(start[1:], len(cp))
    row = np.searchsorted(cut, start, "right") - 1
    h, kept, part = np.unique(tb.span_hash(_prefix(cp), start, stop), return_index=True, return_inverse=True)
    where = parts.starts(h, cp, start[kept], (stop - start)[kept])
    lo, token, run, of = parts.lo, parts.token, parts.run, parts.of
    place = np.arange(len(start)) - np.searchsorted(row, np.arange(rows))[row]
    state = tb.mix(keys.astype(np.uint64)[row] + tb.mix(place.astype(np.uint64) * np.uint64(2654435761) + np.uint64(seed)))
    live = np.arange(len(start))
    low = where[part]
    node = low + (stop - start) - 1
    steps = []
    while len(live):
        u = (tb.mix(state[live] + np.uint64(len(steps) + 1) * np.uint64(0x9E3779B9)) >> np.uint64(11)).astype(float) * 2.0**-53
        arc = of[node]
        wait = np.flatnonzero(u >= run[arc])
        while len(wait):
            arc[wait] += 1
            wait = wait[u[wait] >= run[arc[wait]]]
        steps.append((live, token[arc]))
        on = lo[arc] > low
        live, node, low = live[on], lo[arc][on] - 1, low[on]
    taken = np.zeros(len(start), np.int64)
    for who, _ in steps:
        taken[who] += 1
    last = np.cumsum(taken)
    out = np.empty(last[-1], np.int64)
    for k, (who, what) in enumerate(steps):
        out[last[who] - 1 - k] = what
    owner = np.repeat(row, taken)
    return _expand(out, owner, rows, parts.voc)


def _expand(out, owner, rows, voc):
    """Replace fallback tokens by the byte pieces of their characters."""
    bare = np.flatnonzero(out >= voc.n)
    if not len(bare):
        return out, np.bincount(owner, minlength=rows)
    kinds, which = np.unique(out[bare], return_inverse=True)
    raw = [chr(c if c != LITERAL else SPACE).encode() for c in kinds - voc.n]
    many = np.ones(len(out), np.int64)
    many[bare] = np.array([len(r) for r in raw])[which]
    at = np.cumsum(many) - many
    full = np.repeat(out, many)
    for j in range(4):
        has = np.array([len(r) > j for r in raw])[which]
        full[at[bare[has]] + j] = voc.byte[np.array([r[j] if len(r) > j else 0 for r in raw])[which[has]]]
    return full, np.bincount(np.repeat(owner, many), minlength=rows)


def join(ids: np.ndarray, cut: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that pieces stand for, without the space in front of each row; row offsets."""
    size = voc.size[ids]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    out = voc.bytes[np.repeat(voc.at[ids] - (end - size), size) + np.arange(total)]
    off = np.concatenate(([0], end))[cut]
    first = off[:-1][np.diff(off) > 0]
    keep = np.ones(total, bool)
    keep[first[out[first] == 32]] = False
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def _strings(data: np.ndarray, off: np.ndarray, most: int = MOST_BYTES):
    """Arrays of strings of at most ``most`` bytes each, which 32-bit offsets hold, with their first and last row; a longer row is one array."""
    a, rows = 0, len(off) - 1
    while a < rows or not rows:
        b = max(int(np.searchsorted(off, off[a] + most, "right")) - 1, min(a + 1, rows))
        own = np.ascontiguousarray(data[off[a] : off[b]])
        yield a, b, pa.StringArray.from_buffers(b - a, pa.py_buffer((off[a : b + 1] - off[a]).astype(np.int32)), pa.py_buffer(own))
        if not rows:
            return
        a = b


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 0, decoded: bool = False) -> DataFrame:
    """id and ``pieces``, the sampled piece ids of each whole text; with decoded, the text that they give back."""
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(model, alpha))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    names = [id_col, "pieces", *["decoded"] * decoded]

    def run(batches):
        parts = Parts(held.value)
        for batch in batches:
            ids, cut = sample(*tb.strings(batch.column(2)), np.asarray(batch.column(1)), parts, seed)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))], names=names[:2])
            if not decoded:
                yield out
                continue
            for a, b, text in _strings(*join(ids, cut, parts.voc)):
                yield pa.RecordBatch.from_arrays([*out.slice(a, b - a).columns, text], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, key.alias("key"), text_col).mapInArrow(run, f"`{id_col}` {kind}, pieces array<int>" + ", decoded string" * decoded)


def decode(pieces: DataFrame, *, col: str = "pieces", model: str = MODEL) -> DataFrame:
    """The columns of pieces, and ``decoded``, the text that col stands for (null: empty)."""
    held = pieces.sparkSession.sparkContext.broadcast(Vocabulary(model))
    kept = pieces.drop("decoded")
    names = kept.columns
    place = names.index(col)

    def run(batches):
        voc = held.value
        for batch in batches:
            got = batch.column(place)
            cut = np.concatenate(([0], np.cumsum(got.value_lengths().fill_null(0))))
            for a, b, text in _strings(*join(np.asarray(got.flatten()), cut.astype(np.int64), voc)):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, text], names=[*names, "decoded"])

    return kept.mapInArrow(run, kept.withColumn("decoded", F.lit("")).schema)
