r"""Information-theoretic sanitisation of personal data.

Base: patterns find e-mail addresses, IP addresses, card and phone numbers. These
values are the protected entities. The corpus then tells how strongly other words
reveal them. With N words in all, n(t) occurrences of a word t, n(e) words near
mentions of an entity e (WINDOW words on either side) and n(e, t) of these being t,

    PMI(e; t) = log2(N n(e, t) / (n(e) n(t))),   IC(e) = log2(N / n(e)),

and PMI / IC, at most 1, is the share of e's information that t gives away. Words
whose share for some entity reaches ``generalise`` become a placeholder wherever
they stand, in any document; from ``remove`` on they go. A share needs ``support`` different contexts, so copies of
one text prove nothing.

Counts of words run over all documents; a fixed-size bitmap of the words that
have support (2 MB) spares the others the shuffle, and only costs time when full.

Defined cases: null text counts as empty; rows are known by id (null too) and
text, so repeated rows get equal results; overlapping findings of several kinds
are all reported, and replaced as one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm import textbytes as tb
from relgraph.llm.runtime import materialise

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW, SUPPORT, GENERALISE, REMOVE = 16, 3, 0.8, 0.95
BITS = 1 << 24
#: Spans (24 bytes each) that may be sent to every task instead of shuffling texts.
BROADCAST_SPANS = 500_000

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits matches from its start or not at all, so later starts are skipped
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_OTHER = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches; each starts where the run of local characters before its @ does."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
        end = m.end() if m else at + 1
        at = text.find("@", end)


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, sorted."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _OTHER.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_OTHER.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def _entity(text: str, kind: int) -> int:
    said = text.lower() if kind < 2 else _OTHER.sub("", text)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{said}".encode(), digest_size=8).digest(), "little", signed=True)


def _key(id_col: str, text_col: str):
    return F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text) and base spans, flat: start, end, kind."""

    def run(batches):
        for batch in batches:
            spans = [[x for s in base(t) for x in s] if t else [] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, pa.list_(pa.int64()))], names=["id", "th", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(*_key(id_col, text_col), text_col).mapInArrow(run, f"id {kind}, th long, spans array<long>")


def mentions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, e, t, context, start, end): words t near mentions of entities e.

    A word near several mentions of one entity counts once, with the first.
    """

    def rows(text: str):
        found = base(text)
        if not found:
            return
        raw = np.frombuffer(text.encode(), np.uint8)
        low = tb.lower(raw)
        s, e, _ = tb.words(low, np.array([0, len(low)]), tb.ALNUM)
        if not len(s):
            return
        h = tb.span_hash(tb.prefix(low), s, e).view(np.int64)
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        s, e = chars[s], chars[e]
        free = np.ones(len(s), bool)
        for a, b, _ in found:
            free[np.searchsorted(e, a, "right") : np.searchsorted(s, b, "left")] = False
        near: dict[int, set] = {}
        for a, b, kind in found:
            who = _entity(text[a:b], kind)
            x, y = np.searchsorted(e, a, "right"), np.searchsorted(s, b, "left")
            around = [k for k in (*range(max(0, x - window), x), *range(y, min(len(s), y + window))) if free[k]]
            context = int(np.bitwise_xor.reduce(tb.mix(h[around].view(np.uint64) + np.arange(len(around), dtype=np.uint64))).view(np.int64)) if around else 0
            seen = near.setdefault(who, set())
            for k in around:
                if k not in seen:
                    seen.add(k)
                    yield who, int(h[k]), context, int(s[k]), int(e[k])

    def run(batches):
        names = ["id", "th", "e", "t", "context", "start", "end"]
        for batch in batches:
            where, out = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for r in rows(text or ""):
                    where.append(k)
                    out.append(r)
            if out:
                keys = [c.take(pa.array(where)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(*_key(id_col, text_col), text_col).mapInArrow(run, f"id {kind}, th long, e long, t long, context long, start long, end long")


def _bitmap(words: DataFrame) -> np.ndarray:
    """BITS bits, set where a word's hash falls; 512 rows of 4 kB at most."""
    at = F.pmod(F.col("t"), F.lit(BITS)) + 1
    rows = words.select(at.alias("k")).groupBy(F.bitmap_bucket_number("k").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits")).collect()
    out = np.zeros(BITS, bool)
    for r in rows:
        a = (r.b - 1) * 32768
        out[a : a + 32768] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
    return np.packbits(out)


def occurrences(docs: DataFrame, wanted: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(t, n) of all words over all documents that may be in wanted (t); t null: all words."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches):
        bits, parts, total = np.unpackbits(held.value).astype(bool), [], 0

        def merge():
            h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            word, at = np.unique(h, return_inverse=True)
            parts[:] = [(word, np.bincount(at, n, len(word)).astype(np.int64))]
            return parts[0]

        def rows():
            h, n = merge()
            parts.clear()
            for a in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 50_000].view(np.int64)), pa.array(n[a : a + 50_000])], names=["t", "n"])

        size = 0
        for batch in batches:
            data, off = tb.strings(batch.column(0))
            for a, b in tb.pieces(off):
                low = tb.lower(data[off[a] : off[b]])
                s, e, _ = tb.words(low, off[a : b + 1] - off[a], tb.ALNUM)
                h = tb.span_hash(tb.prefix(low), s, e)
                total += len(h)
                # pmod of the signed value by a power of two: its low bits
                h = h[bits[(h & np.uint64(BITS - 1)).astype(np.int64)]]
                if len(h):
                    word, n = np.unique(h, return_counts=True)
                    parts.append((word, n))
                    size += len(word)
            if size > 1_000_000:
                size = len(merge()[0])
                if size > 500_000:
                    yield from rows()
                    size = 0
        if parts:
            yield from rows()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["t", "n"])

    return docs.select(text_col).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, wanted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, t, start, end): words outside base findings, over all documents, that may be in wanted (t)."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches):
        bits = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            data, off = tb.strings(batch.column(2))
            for a, b in tb.pieces(off):
                raw, cut = data[off[a] : off[b]], off[a : b + 1] - off[a]
                low = tb.lower(raw)
                s, e, row = tb.words(low, cut, tb.ALNUM)
                h = tb.span_hash(tb.prefix(low), s, e)
                on = np.flatnonzero(bits[(h & np.uint64(BITS - 1)).astype(np.int64)])
                if not len(on):
                    continue
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                row, h, zero = row[on], h[on], chars[cut[row[on]]]
                s, e = chars[s[on]] - zero, chars[e[on]] - zero
                free = np.ones(len(on), bool)
                for r in np.unique(row).tolist():
                    x, y = np.searchsorted(row, (r, r + 1))
                    for first, last, _ in base(batch.column(2)[a + r].as_py()):
                        free[x:y] &= (e[x:y] <= first) | (s[x:y] >= last)
                keys = [c.take(pa.array(a + row[free])) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(h[free].view(np.int64)), pa.array(s[free].astype(np.int64)), pa.array(e[free].astype(np.int64))], names=["id", "th", "t", "start", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(*_key(id_col, text_col), text_col).mapInArrow(run, f"id {kind}, th long, t long, start long, end long")


def terms(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(id, th, found): spans of words that disclose an entity: start, end, share."""
    near = materialise(mentions(docs, id_col=id_col, text_col=text_col, window=window), "pii-mentions")
    # contexts first: a hot entity or word is many groups, each summed before it moves
    by_context = near.groupBy("e", "t", "context").agg(F.count("*").alias("n"))
    pairs = by_context.groupBy("e", "t").agg(F.sum("n").alias("n_et"), F.count("*").alias("contexts"))
    pairs = materialise(pairs, "pii-pairs")
    backed = pairs.where(F.col("contexts") >= support)
    counts = materialise(occurrences(docs, backed.select("t").distinct(), text_col=text_col), "pii-words")
    total = counts.where("t is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_e = pairs.groupBy("e").agg(F.sum("n_et").alias("n_e"))
    share = 1 - F.log2(F.col("n_t") / F.col("n_et")) / F.log2(F.lit(float(total)) / F.col("n_e"))
    told = backed.join(counts.select("t", F.col("n").alias("n_t")), "t").join(n_e, "e").where(F.col("n_e") < total)
    told = told.withColumn("share", share).where(F.col("share") >= generalise)
    told = materialise(told.groupBy("t").agg(F.max("share").alias("share")), "pii-told")
    side = F.broadcast(told) if told.count() <= BROADCAST_SPANS else told
    spans = places(docs, told, id_col=id_col, text_col=text_col).join(side, "t").groupBy("id", "th", "start", "end").agg(F.max("share").alias("share"))
    return spans.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("found"))


def all_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """id, base (flat start, end, kind) and found (start, end, share) for every row of docs."""
    got = find(docs, id_col=id_col, text_col=text_col)
    extra = terms(docs, id_col=id_col, text_col=text_col, **more).withColumnsRenamed({"id": "id_", "th": "th_"})
    on = got["id"].eqNullSafe(extra["id_"]) & (got["th"] == extra["th_"])
    return got.join(extra, on, "left").select(F.col("id").alias(id_col), F.col("spans").alias("base"), F.coalesce("found", F.array().cast("array<struct<start:bigint,end:bigint,share:double>>")).alias("found"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **more) -> DataFrame:
    """docs with personal data replaced by [KIND], disclosing words by [TERM] or nothing."""
    names, schema = docs.columns, docs.schema
    extra = materialise(terms(docs, id_col=id_col, text_col=text_col, **more).withColumnsRenamed({"id": "__id", "th": "__th", "found": "__found"}), "pii-terms")
    size = extra.agg(F.coalesce(F.sum(F.size("__found")), F.lit(0))).first()[0]
    side = F.broadcast(extra) if size <= BROADCAST_SPANS else extra
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(side, F.col(id_col).eqNullSafe(F.col("__id")) & (key == F.col("__th")), "left").select(*names, "__found")
    place = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts, found = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            cols = batch.columns[:-1]
            cols[place] = pa.array([t and _replace(t, f or [], remove) for t, f in zip(texts, found, strict=True)], batch.column(place).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = joined.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length(text_col).cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def _replace(text: str, found: list, remove: float) -> str:
    spans = [(a, b, f"[{KINDS[k].upper()}]") for a, b, k in base(text)]
    spans += [(f["start"], f["end"], "" if f["share"] >= remove else "[TERM]") for f in found]
    if not spans:
        return text
    out, at = [], 0
    for a, b, said in sorted(spans):
        if a >= at:
            out += (text[at:a], said)
        at = max(at, b)
    return "".join([*out, text[at:]])
