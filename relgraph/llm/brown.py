"""Language-model scoring with Brown classes.

Every training word has a class. Exchange clustering first moves units, the
commonest words and the shapes of all others, between classes until no move raises
the likelihood of class bigrams. Then each further word leaves its shape's class
for the one that raises the likelihood most, given how often each class stands
before and after the word. A word that training has not seen has its shape's
class. A text's probability is the product over its tokens of P(class | class
before) and P(word | class), both smoothed by adding.

Counts cover all training texts: words, unit bigrams (at most units^2 rows,
whatever the corpus), words by neighbour class, and bigrams of the final classes
are grouped sums. Words are known by 64-bit hashes.

The vocabulary reaches the tasks as a broadcast of at most ``max_words`` of the
commonest words (26 bytes each at most). Texts with words beyond those, rare by
construction, are joined with the counts and classes of these words.

Defined cases: null and empty text is one token, the end; texts whose id is null
count like others (the caller's predicate says whether they teach); repeated rows
count and are scored each; without training texts every count is 0 and the single
class of a text's tokens is certain; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm import textbytes as tb
from relgraph.llm.runtime import materialise

HEAD, CLASSES, MAX_WORDS = 512, 48, 4_000_000
#: The end of a text as a token; it also stands before the first one.
END = np.uint64(0x5EED)
N_SHAPES = 5 * 3 * 4
_DIGIT = tb._table(lambda i: 48 <= i <= 57)


def tokens(data: np.ndarray, off: np.ndarray):
    """Word hashes, shapes (0 to N_SHAPES - 1) and rows."""
    low = tb.lower(data)
    s, e, row = tb.words(low, off, tb.SOLID)
    h = tb.span_hash(tb.prefix(low), s, e)
    h[h == END] += np.uint64(1)
    size = np.searchsorted([4, 7, 10, 14], e - s, "right")
    kind = lambda c: np.where(_DIGIT[c], 1, np.where(tb.ALNUM[c], 0, 2))
    shape = (size * 3 + kind(low[s])) * 4 + kind(low[e - 1]) + (low[e - 1] >= 128) * (kind(low[e - 1]) == 0) * 3 if len(s) else np.zeros(0, np.int64)
    return h, shape, row


def _batches(batches, col=0):
    """Pieces of text of bounded size: bytes, offsets, first row in the batch."""
    for batch in batches:
        data, off = tb.strings(batch.column(col))
        for a, b in tb.pieces(off):
            yield data[off[a] : off[b]], off[a : b + 1] - off[a]


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, shape, n) over all texts, the end (shape -1) among them."""

    def run(batches):
        held: list = []
        size = ends = 0

        def flush():
            h, shape, n = (np.concatenate(x) for x in zip(*held, strict=True))
            word, first, at = np.unique(h, return_index=True, return_inverse=True)
            held[:] = [(word, shape[first], np.bincount(at, n).astype(np.int64))]
            return len(word)

        def rows():
            h, shape, n = held.pop()
            for a in range(0, len(h), 50_000):
                b = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[b].view(np.int64)), pa.array(shape[b].astype(np.int32)), pa.array(n[b])], names=["word", "shape", "n"])

        for data, off in _batches(batches):
            h, shape, _ = tokens(data, off)
            ends += len(off) - 1
            word, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((word, shape[first], n))
            size += len(word)
            if size > 2_000_000:
                size = flush()
                if size > 1_000_000:
                    yield from rows()
                    size = 0
        if held:
            flush()
            yield from rows()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([int(END)], pa.int64()), pa.array([-1], pa.int32()), pa.array([ends], pa.int64())], names=["word", "shape", "n"])

    parts = texts.select(text_col).mapInArrow(run, "word long, shape int, n long")
    return parts.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def _units(h: np.ndarray, shape: np.ndarray, head: np.ndarray) -> np.ndarray:
    """0: the end; then the shapes; then the head words (sorted hashes)."""
    out = shape + 1
    if len(head):
        k = np.minimum(np.searchsorted(head, h), len(head) - 1)
        out = np.where(head[k] == h, k + 1 + N_SHAPES, out)
    return out


def _sequence(data, off, head):
    """Units of all tokens with each text's end, the unit before each, hashes, rows."""
    h, shape, row = tokens(data, off)
    rows = len(off) - 1
    last = np.searchsorted(row, np.arange(rows), "right")
    unit = np.insert(_units(h, shape, head), last, 0)
    word = np.insert(h, last, END)
    row = np.insert(row, last, np.arange(rows))
    before = np.zeros(len(unit), np.int64)
    before[1:] = unit[:-1]  # the end of the text before stands for its own start
    return unit, before, word, row


def bigrams(texts: DataFrame, head: np.ndarray, text_col: str = "text") -> DataFrame:
    """(a, b, n): how often unit b follows unit a."""
    held = texts.sparkSession.sparkContext.broadcast(head)
    m = 1 + N_SHAPES + len(head)

    def run(batches):
        total = np.zeros(m * m, np.int64)  # 3 MB with 512 head words
        for data, off in _batches(batches):
            unit, before, _, _ = _sequence(data, off, held.value)
            total += np.bincount(before * m + unit, minlength=m * m)
        at = np.flatnonzero(total)
        for x in range(0, len(at), 50_000):
            k = at[x : x + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array((k // m).astype(np.int32)), pa.array((k % m).astype(np.int32)), pa.array(total[k])], names=["a", "b", "n"])

    return texts.select(text_col).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def _near(tokens: float) -> float:
    """Likelihoods that differ by less are equal: more than rounding, so that moves come to an end."""
    return 1e-9 + 1e-13 * float(_xlogx(np.array(tokens)))


def exchange(n: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """A class for each unit. n[a, b]: how often b follows a.

    Class 0 holds the end alone. Units start in classes by turns, the commonest
    first, and move one by one to the class that raises the likelihood most, until
    none moves; ties stay, else go to the smaller class.
    """
    m = len(n)
    f, near = _xlogx, _near(n.sum())
    total = n.sum(0) + n.sum(1)
    order = [int(u) for u in np.argsort(-total, kind="stable") if u and total[u]]
    of = np.zeros(m, np.int64)
    free = max(classes - 1, 1)
    for k, u in enumerate(order):
        of[u] = 1 + k % free
    pick = np.zeros((m, free + 1))
    pick[np.arange(m), of] = 1
    big = pick.T @ n @ pick
    moved = True
    while moved:
        moved = False
        for u in order:
            a = of[u]
            row, col, own = n[u] @ pick, n[:, u] @ pick, n[u, u]
            row[a] -= own
            col[a] -= own
            big[a] -= row
            big[:, a] -= col
            big[a, a] -= own
            # how often a class is second and first, u's neighbours being counted wherever u goes
            to, frm = big.sum(0) + row, big.sum(1) + col
            gain = (f(big + row) - f(big)).sum(1) + (f(big.T + col) - f(big.T)).sum(1)
            d = np.diag(big)
            gain += f(d + row + col + own) - f(d + row) - f(d + col) + f(d)
            gain -= f(frm + row.sum() + own) - f(frm) + f(to + col.sum() + own) - f(to)
            gain[0] = -np.inf
            b = int(a if gain[a] >= gain.max() - near else np.argmax(gain > gain.max() - near))
            big[b] += row
            big[:, b] += col
            big[b, b] += own
            if b != a:
                pick[u, a], pick[u, b], of[u] = 0, 1, b
                moved = True
    of[[u for u in range(1, m) if not total[u]]] = 1  # shapes that no training word has
    return of


def neighbours(texts: DataFrame, head: np.ndarray, of: np.ndarray, classes: int, text_col: str = "text") -> DataFrame:
    """(word, shape, codes) of words outside the head, for each task and word: codes hold k * 2^40 + n.

    n times, for k < classes, that class stands before; for k < 2 classes, after; for 2 classes the word itself follows.
    """
    held = texts.sparkSession.sparkContext.broadcast((head, of))
    width = 2 * classes + 1

    def run(batches):
        head, of = held.value
        parts: list = []
        size = 0

        def merge():
            h, shape, k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            word, first, at = np.unique(h, return_index=True, return_inverse=True)
            code, at = np.unique(at * width + k, return_inverse=True)
            w = code // width
            parts[:] = [(word[w], shape[first][w], code % width, np.bincount(at, n).astype(np.int64))]
            return len(code)

        def rows():
            h, shape, k, n = parts.pop()
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            cut = np.append(first, len(h))
            for a in range(0, len(first), 20_000):
                b = min(a + 20_000, len(first))
                own = slice(cut[a], cut[b])
                codes = pa.ListArray.from_arrays(pa.array(cut[a : b + 1] - cut[a], pa.int32()), pa.array((k[own] << 40) + n[own]))
                yield pa.RecordBatch.from_arrays([pa.array(h[first[a:b]].view(np.int64)), pa.array(shape[first[a:b]].astype(np.int32)), codes], names=["word", "shape", "codes"])

        for data, off in _batches(batches):
            unit, before, word, _ = _sequence(data, off, head)
            at = np.flatnonzero((unit > 0) & (unit <= N_SHAPES))
            if not len(at):
                continue
            same = np.zeros(len(word) + 1, bool)  # as the word before; the end parts texts
            same[1:-1] = word[1:] == word[:-1]
            h, who = np.unique(word[at], return_inverse=True)
            shape = np.zeros(len(h), np.int64)
            shape[who] = unit[at] - 1
            first = np.where(same[at], 2 * classes, of[before[at]])
            after = at + 1  # the end at least
            ahead = ~same[after]
            code = np.concatenate((who * width + first, who[ahead] * width + classes + of[unit[after[ahead]]]))
            code, n = np.unique(code, return_counts=True)
            parts.append((h[code // width], shape[code // width], code % width, n))
            size += len(code)
            if size > 2_000_000:
                size = merge()
                if size > 1_000_000:
                    yield from rows()
                    size = 0
        if parts:
            merge()
            yield from rows()

    return texts.select(text_col).mapInArrow(run, "word long, shape int, codes array<long>")


def best_class(who: np.ndarray, k: np.ndarray, n: np.ndarray, a: np.ndarray, big: np.ndarray) -> np.ndarray:
    """The class of each word, from its counts (who, k, n) as of ``neighbours``, its class so far and the class bigrams.

    This is the move of ``exchange``, with only the classes that are neighbours looked at.
    """
    m, classes = len(a), len(big)
    width = 2 * classes + 1
    counts = np.bincount(who * width + k, n, m * width).reshape(m, width)
    col, row, own = counts[:, :classes], counts[:, classes:-1], counts[:, -1]
    every = np.arange(m)
    gain = np.zeros((m, classes))
    for mine, other, seen in ((row, col, big.T), (col, row, big)):
        w, c = np.nonzero(mine)
        if not len(w):
            continue
        x = mine[w, c]
        was = seen[c].copy()  # what the neighbour's class has with each class, without the word
        was[np.arange(len(w)), a[w]] -= x
        inside = np.flatnonzero(c == a[w])
        was[inside] -= other[w[inside]]
        was[inside, a[w[inside]]] -= own[w[inside]]
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        gain[w[first]] += np.add.reduceat(_xlogx(was + x[:, None]) - _xlogx(was), first)
    d = np.tile(np.diag(big), (m, 1))
    d[every, a] -= row[every, a] + col[every, a] + own
    whole = own[:, None]
    gain += _xlogx(d + row + col + whole) - _xlogx(d + row) - _xlogx(d + col) + _xlogx(d)
    for total, mine in ((big.sum(1), row), (big.sum(0), col)):
        more = mine.sum(1, keepdims=True) + whole
        base = np.tile(total, (m, 1))
        base[every, a] -= more[:, 0]
        gain -= _xlogx(base + more) - _xlogx(base)
    gain[:, 0] = -np.inf
    top, near = gain.max(1, keepdims=True), _near(big.sum())
    return np.where(gain[every, a] >= top[:, 0] - near, a, np.argmax(gain > top - near, axis=1))


def _assigned(counts: DataFrame, of: np.ndarray, big: np.ndarray) -> DataFrame:
    """(word, class) of the words in counts, all moved from the same class bigrams.

    The rows of a word pass one after another and are summed on the way, so a common word is no large group.
    """
    held = counts.sparkSession.sparkContext.broadcast((of, big))
    low = (1 << 40) - 1

    def run(batches):
        of, big = held.value
        parts: list = []
        rows = 0

        def moved(last: bool):
            word, shape, size, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            cut = np.append(0, np.cumsum(size))
            words = len(new) if last else len(new) - 1  # of the last word more rows may follow
            stop = np.append(new, len(word))
            parts[:] = []
            if not last:
                x = stop[words]
                k, at = np.unique(codes[cut[x] :] >> 40, return_inverse=True)
                n = np.bincount(at, codes[cut[x] :] & low).astype(np.int64)
                parts.append((word[x : x + 1], shape[x : x + 1], np.array([len(k)]), (k << 40) + n))
            for a in range(0, words, 1024):
                b = min(a + 1024, words)
                x, y = stop[a], stop[b]
                who = np.repeat(np.searchsorted(new[a:b], np.arange(x, y), "right") - 1, size[x:y])
                own = codes[cut[x] : cut[y]]
                got = best_class(who, own >> 40, (own & low).astype(float), of[1 + shape[new[a:b]]], big)
                yield pa.RecordBatch.from_arrays([pa.array(word[new[a:b]]), pa.array(got.astype(np.int32))], names=["word", "class"])

        for batch in batches:
            codes = batch.column(2)
            if batch.num_rows:
                parts.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.diff(np.asarray(codes.offsets)), np.asarray(codes.flatten())))
                rows += batch.num_rows
            if rows > 30_000:
                yield from moved(False)
                rows = 1
        if parts:
            yield from moved(True)

    return counts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, class int")


def _slots(word: np.ndarray) -> tuple[np.ndarray, int]:
    """Where words (sorted) of each first bits begin, about one a slot, and the most of a slot."""
    bits = max(len(word).bit_length(), 1)
    slot = np.searchsorted(word, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
    return slot, int(np.diff(np.append(slot, len(word))).max())


def _find(own: dict, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of w among the words of own, and which are there: a step or two from a slot, where a binary search waits for memory over 20 times."""
    word, slot = own["word"], own["slot"]
    if not len(word):
        return np.zeros(len(w), np.int32), np.zeros(len(w), bool)
    last = len(word) - 1
    at = np.minimum(slot[(w >> np.uint64(65 - len(slot).bit_length())).astype(np.int64)], last)
    off = np.flatnonzero(word[at] < w)
    for _ in range(own["most"] - 1):
        if not len(off):
            break
        at[off] = np.minimum(at[off] + 1, last)
        off = off[word[at[off]] < w[off]]
    return at, word[at] == w


def _commonest(vocabulary: DataFrame, words: int, max_words: int):
    """A broadcast of word, n and class of at most max_words words, sorted by word, with their slots."""
    known = vocabulary.select("word", "n", F.col("class").cast("short").alias("class"))
    arrow = (known if words <= max_words else known.orderBy(F.desc("n"), "word").limit(max_words)).toArrow()
    word = np.asarray(arrow["word"]).view(np.uint64)
    order = np.argsort(word)
    own = {"word": word[order], "n": np.asarray(arrow["n"])[order], "of": np.asarray(arrow["class"])[order]}
    own["slot"], own["most"] = _slots(own["word"])
    del arrow, word, order
    return vocabulary.sparkSession.sparkContext.broadcast(own)


def _with_words(texts: DataFrame, vocabulary: DataFrame, held, whole: bool) -> DataFrame:
    """texts (..., text) with ``rest``, their words (word, n, class) beyond those of held."""
    known = vocabulary.select("word", "n", "class")
    kind = "array<struct<word:bigint,n:bigint,class:int>>"
    if whole:
        return texts.withColumn("rest", F.array().cast(kind))

    def rare(batches):
        for batch in batches:
            x = 0
            for data, off in _batches([batch], 1):
                h, _, row = tokens(data, off)
                new = ~_find(held.value, h)[1]
                h, row = h[new], row[new]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x + row)), pa.array(h.view(np.int64))], names=["at", "word"])
                x += len(off) - 1

    texts = materialise(texts.withColumn("at", F.monotonically_increasing_id()), "brown-texts")
    found = texts.select("at", "text").mapInArrow(rare, "at long, word long").distinct().join(known, "word")
    found = found.groupBy("at").agg(F.collect_list(F.struct("word", "n", "class")).alias("rest"))
    return texts.join(found, "at", "left").drop("at").withColumn("rest", F.coalesce("rest", F.array().cast(kind)))


def _look_up(own: dict, rest: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and classes of words; 0 and -1 where training has not seen them."""
    at, hit = _find(own, w)
    n, of = np.zeros(len(w), np.int64), np.full(len(w), -1, np.int64)
    n[hit], of[hit] = own["n"][at[hit]], own["of"][at[hit]]
    more = rest.flatten()
    if len(more):
        word, first = np.unique(np.asarray(more.field("word")).view(np.uint64), return_index=True)
        at = np.minimum(np.searchsorted(word, w), len(word) - 1)
        hit = word[at] == w
        n[hit], of[hit] = np.asarray(more.field("n"))[first][at[hit]], np.asarray(more.field("class"))[first][at[hit]]
    return n, of


def class_bigrams(texts: DataFrame, vocabulary: DataFrame, held, whole: bool, classes: int, text_col: str = "text") -> np.ndarray:
    """How often a word of class b follows one of class a."""
    texts = _with_words(texts.select(F.col(text_col).alias("text")), vocabulary, held, whole)

    def run(batches):
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            x = 0
            for data, off in _batches([batch]):
                _, _, w, _ = _sequence(data, off, np.zeros(0, np.uint64))
                of = _look_up(held.value, batch.column(1).slice(x, len(off) - 1), w)[1]  # all are known
                x += len(off) - 1
                before = np.zeros(len(of), np.int64)
                before[1:] = of[:-1]
                total += np.bincount(before * classes + of, minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // classes).astype(np.int32)), pa.array((at % classes).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])

    out = np.zeros((classes, classes))
    for r in texts.select("text", "rest").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[r.a, r.b] = r.n
    return out


def fit(texts: DataFrame, *, text_col: str = "text", head: int = HEAD, classes: int = CLASSES, max_words: int = MAX_WORDS) -> dict:
    """The model: ``vocabulary``, a table of all words with counts and classes, and bounded arrays."""
    spark = texts.sparkSession
    counted = materialise(word_counts(texts, text_col), "brown-words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counted.where("shape >= 0").orderBy(F.desc("n"), "word").limit(head).select("word").collect()
    heads = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    m = 1 + N_SHAPES + len(heads)
    n = np.zeros((m, m))
    pairs = bigrams(texts, heads, text_col).toArrow()
    n[np.asarray(pairs["a"]), np.asarray(pairs["b"])] = np.asarray(pairs["n"])
    del pairs
    of = exchange(n, classes)
    k = classes if classes > 1 else 2
    pick = np.zeros((m, k))
    pick[np.arange(m), of] = 1
    fixed = [(int(np.uint64(END).view(np.int64)), 0), *zip(heads.view(np.int64).tolist(), of[1 + N_SHAPES :].tolist(), strict=True)]
    named = spark.createDataFrame(fixed, "word long, class int").union(_assigned(neighbours(texts, heads, of, k, text_col), of, pick.T @ n @ pick))
    vocabulary = materialise(counted.join(named, "word"), "brown-classes")
    held = _commonest(vocabulary, total[1], max_words)
    big = class_bigrams(texts, vocabulary, held, total[1] <= max_words, k, text_col)
    step = np.log10((big + 0.1) / (big.sum(1, keepdims=True) + 0.1 * k))
    size = np.zeros(k)  # tokens and types of each class
    for r in vocabulary.groupBy("class").agg((F.sum("n") + F.count("*")).alias("size")).collect():
        size[r["class"]] = r["size"]
    return {"vocabulary": vocabulary, "tokens": total[0], "words": total[1], "class": of[: 1 + N_SHAPES], "step": step, "room": np.log10(size + 1), "held": (max_words, held)}


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", keep: dict | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """id, the columns of keep (name: expression), n_tokens, n_known, train_tokens, base_score, score."""
    extra = keep or {}
    room = float(np.log10(model["tokens"] + model["words"] + 1))
    names = ["id", *extra]
    df = docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in extra.items()), F.col(text_col).alias("text"))
    kept = df.drop("text").schema
    most, held = model["held"]  # collected once, by fit
    if most != max_words:
        held = _commonest(model["vocabulary"], model["words"], max_words)
    df = _with_words(df, model["vocabulary"], held, model["words"] <= max_words)
    own = {k: model[k] for k in ("class", "step", "room")}

    def run(batches):
        b = own | held.value
        for batch in batches:
            size, known, logs, model_ = [], [], [], []
            x = 0
            for data, off in _batches([batch], batch.num_columns - 2):
                unit, _, w, row = _sequence(data, off, np.zeros(0, np.uint64))
                rows = len(off) - 1
                n, c = _look_up(b, batch.column(batch.num_columns - 1).slice(x, rows), w)
                x += rows
                c = np.where((c < 0) | (unit == 0), b["class"][unit], c)
                before = np.zeros(len(c), np.int64)
                before[1:] = c[:-1]  # the end has class 0
                part = b["step"][before, c] - b["room"][c]
                size.append(np.bincount(row, minlength=rows))
                known.append(np.bincount(row, n > 0, rows).astype(np.int64))
                logs.append(np.bincount(row, np.log10(n + 1.0), rows))
                model_.append(np.bincount(row, part, rows))
            if size:
                cols = [pa.array(np.concatenate(x)) for x in (size, known, logs, model_)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *cols], names=[*names, "n_tokens", "n_known", "logs", "part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    out = df.select(*names, "text", "rest").mapInArrow(run, f"{schema}, n_tokens long, n_known long, logs double, part double")
    return out.select(
        F.col("id").alias(id_col), *extra, "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * room).alias("base_score"), (F.col("logs") + F.col("part")).alias("score"),
    )
