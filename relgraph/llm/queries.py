"""The operators' queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.llm import audit, brown, chat, decontam, jaccard, neardup, pieces, pii, quality, sessions, sharding, suffixdup, topk
from relgraph.llm.runtime import crc_mod, prepare, scratch_path, table

#: Arrivals that op2 deals the documents to.
ARRIVALS = 6


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector among all others."""
    prepare(spark)
    found = topk.search(table(spark, sf_dir, "embeddings"), lambda c: c % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, appended in arrivals, compacted, and read back from the last version."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")  # files as they are: each task writes one an arrival
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)).cast("int")
    store = sharding.ingest(docs, scratch_path(spark, "shards"), arrival, target=32 << 20)
    return store.read().select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "lang", "source", "n_chars")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 10-word windows of the benchmark in every document."""
    prepare(spark)
    found = decontam.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    hits = F.aggregate("decontam.hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda a, x: F.struct((a["n"] + x * a["s"]).alias("n"), (-a["s"]).alias("s")), lambda a: a["n"])
    return found.select(
        "doc_id", F.col("decontam.n_words").alias("n_words"), hits.alias("n_hit"), F.size("decontam.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("decontam.items"), ","), 256).alias("items_sha256"), (F.size("decontam.hits") > 0).alias("contaminated"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base findings and disclosing words of every document."""
    prepare(spark)
    found = pii.all_spans(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    spans = F.transform(F.sequence(F.lit(0), (F.size("base") / 3).cast("int") - 1), lambda i: F.struct(F.get("base", i * 3).alias("a"), F.get("base", i * 3 + 2).alias("k"), F.get("base", i * 3 + 1).alias("b")))
    spans = F.when(F.size("base") > 0, spans).otherwise(F.array().cast("array<struct<a:bigint,k:bigint,b:bigint>>"))
    extra = F.transform("found", lambda x: F.struct(x["start"].alias("a"), F.lit(4).cast("long").alias("k"), x["end"].alias("b")))
    say = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(kinds, x["k"].cast("int")), x["a"].cast("string"), x["b"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    found = found.select("doc_id", F.array_sort(spans).alias("spans"), extra.alias("extra"))
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])], F.sha2(say("spans"), 256).alias("base_sha256"), say(F.array_sort(F.concat("spans", "extra"))).alias("spans"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document at similarity 0.8 of 5-word shingles."""
    prepare(spark)
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeats of 100 bytes."""
    prepare(spark)
    found = suffixdup.remove(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document; a third of the labels is held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=lambda c: crc_mod(c, 3) != 1)
    return quality.score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one of control strings, read back from their formatted texts."""
    prepare(spark)
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], chats.schema)
    return chat.digest(chat.format_chats(chats.union(odd)))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and a digest of what they decode to."""
    prepare(spark)
    got = pieces.encode(table(spark, sf_dir, "documents"), decoded=True)
    return got.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, learnt from six sevenths of them."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 7) == 2
    return brown.score(docs, brown.fit(docs.where(~held)), keep={"held_out": held})


def op11_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every user's sessions, with what retracted it."""
    prepare(spark)
    return sessions.versions(sessions.of_conversations(table(spark, sf_dir, "conversations")), gap=240, width=1800)


def op12_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    prepare(spark)
    found = neardup.join(table(spark, sf_dir, "embeddings"), threshold=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language, and the terms that mark a source."""
    prepare(spark)
    return audit.audit(table(spark, sf_dir, "documents"), min_docs=10, top=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_topk, op2_sharding, op3_decontaminate, op4_pii, op5_jaccard, op6_suffix, op7_quality, op8_chat, op9_sentencepiece, op10_brown, op11_sessions, op12_neardup, op13_audit)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = (  # of a string of ASCII characters
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), "
    "lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT)"
)
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_sharding": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, lang, source, n_chars FROM documents",
    "op3_decontaminate": f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id::VARCHAR AS item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT doc_id, p, k, item_id FROM dw JOIN iw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op5_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
e AS (SELECT doc_id, list_sort(list(g)) AS e FROM g GROUP BY doc_id)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE a = d.doc_id), doc_id)) AS class_id,
  coalesce((SELECT count(*) FROM l WHERE a = d.doc_id), 0)::BIGINT AS n_links,
  coalesce((SELECT min(y.doc_id) FROM e x JOIN e y USING (e) WHERE x.doc_id = d.doc_id), doc_id) AS copy_id
FROM d""",
    "op6_suffix": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS g, substr(h, 2 * p + 1, 2) AS b
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM d)),
f AS (SELECT doc_id, p, b, len(g) = 200 AND row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS again FROM w),
r AS (SELECT doc_id, p, b, coalesce(max(CASE WHEN again THEN p END) OVER (PARTITION BY doc_id ORDER BY p) > p - 100, false) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM r),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
  coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)""",
    "op8_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, len(text) + len(regexp_extract_all(text, '\\|###|</turn>')) + len(role) + len(regexp_extract_all(role, '\\|###|</turn>|:|\n')) + 14 AS size FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op11_sessions": f"""
WITH r AS (SELECT conv_id, turn, {_CRC.format("conv_id::VARCHAR")} AS c, {_CRC.format("conv_id::VARCHAR || ':' || turn")} AS h FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
e0 AS (SELECT 2 * floor(conv_id / 8.0::DOUBLE)::BIGINT + c % 2 AS u, (c // 2) % 7200 + 300 * turn + h % 600 AS sec, h, h // 600 AS g FROM r),
e AS (SELECT u, sec, h, floor(sec / 1800.0::DOUBLE)::BIGINT + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS b FROM e0),
t AS (SELECT DISTINCT u, b FROM e),
f AS (SELECT t.u, t.b, e.sec, e.h, e.b AS eb, coalesce(e.sec - lag(e.sec) OVER (PARTITION BY t.u, t.b ORDER BY e.sec) > 240, true)::INT AS new FROM t JOIN e ON e.u = t.u AND e.b <= t.b),
s AS (SELECT *, sum(new) OVER (PARTITION BY u, b ORDER BY sec) AS k FROM f),
v AS (SELECT u, b, min(sec) AS x, max(sec) AS y, count(*) AS n, count(*) FILTER (eb = b) AS fresh, sum(h) AS h FROM s GROUP BY u, b, k HAVING max(eb) = b),
w AS (SELECT v.u, v.b, v.x, min(o.b) AS rb, arg_min(o.x, o.b) AS rx FROM v JOIN v o ON o.u = v.u AND o.b > v.b AND o.x <= v.x AND o.y >= v.y GROUP BY ALL),
z AS (SELECT u, rb, rx, count(*) AS k FROM w GROUP BY ALL)
SELECT v.u AS "user", v.b AS batch, v.x::BIGINT AS start_s, v.y::BIGINT AS end_s, n AS n_events, fresh AS n_new, coalesce(z.k, 0) AS n_retracted, h::BIGINT AS h_sum,
  w.rb AS retracted_batch, w.rx::BIGINT AS retracted_start_s
FROM v LEFT JOIN w ON w.u = v.u AND w.b = v.b AND w.x = v.x LEFT JOIN z ON z.u = v.u AND z.rb = v.b AND z.rx = v.x""",
    "op12_neardup": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e, vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fit FROM embeddings),
l AS (SELECT x.r AS a, y.r AS b, y.vec_id AS id FROM v x JOIN v y ON x.fit AND y.fit AND x.r <> y.r AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.95),
c(a, b, id) AS (SELECT a, b, id FROM l UNION SELECT c.a, l.b, l.id FROM c JOIN l ON c.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(id) AS id FROM c GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(id, vec_id)) AS component_id, vec_id <= coalesce(id, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN m ON m.a = v.r""",
    "op13_audit": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM o GROUP BY lang, term HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, term, c.n, (1 + (1000000000::HUGEINT * (c.n + 2)) // (t.n + 2 * l.v))::HUGEINT AS p FROM c JOIN t USING (lang, source) JOIN l USING (lang)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v))::HUGEINT AS q FROM k JOIN l USING (lang)),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
WHERE part = 'pair' OR rank <= 10""",
}
