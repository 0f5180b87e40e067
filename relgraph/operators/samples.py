"""Ranked paths, samples, splits and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.functions.scores import harmonic_mean


def rank_paths(found: DataFrame, path_num: int = 5) -> DataFrame:
    """The best paths of each pair that has that many: fewer hops first, then score to 12 places, then nodes (TK1, TK2, FI14)."""
    scored = found.select("a", "b", "nodes", "weights", F.size("weights").alias("hops"), harmonic_mean("weights").alias("score"))
    return best_of_pairs(scored, path_num, "hops", F.desc(F.round("score", 12)), "nodes")


def best_of_pairs(found: DataFrame, path_num: int, *order) -> DataFrame:
    """The first path_num rows of each pair (a, b) that has as many, with ``rank``.

    The limit is applied before the shuffle too, and only what is left of a pair is counted.
    """
    pair = Window.partitionBy("a", "b")
    ranked = found.withColumn("rank", F.row_number().over(pair.orderBy(*order))).where(F.col("rank") <= path_num)
    return ranked.withColumn("n", F.count("*").over(pair)).where(F.col("n") == path_num).drop("n")


def samples(ranked: DataFrame, best: DataFrame) -> DataFrame:
    """(a, b, entity, source, triple): paths coded by places in entity and source lists (GR9).

    best: (a, b, note, score, sim), one sentence for each unordered edge. Lists are in order of first
    occurrence by path rank and hop; places start at 0.
    """
    hop = F.explode(F.transform(F.sequence(F.lit(1), F.size("weights")), lambda i: F.struct(i.alias("hop"), F.element_at("nodes", i).alias("u"), F.element_at("nodes", i + 1).alias("v"))))
    steps = ranked.select("a", "b", "rank", hop.alias("s")).select("a", "b", "rank", "s.*")
    sentence = best.select(F.col("a").alias("x"), F.col("b").alias("y"), "note", "score", "sim")
    steps = steps.withColumns({"x": F.least("u", "v"), "y": F.greatest("u", "v")}).join(sentence, ["x", "y"])
    rows = steps.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("rank", "hop", "u", "v", "note", "score", "sim"))).alias("s"))
    entity = F.array_distinct(F.flatten(F.transform("s", lambda x: F.array(x["u"], x["v"]))))
    source = F.array_distinct(F.transform("s", lambda x: x["note"]))
    rows = rows.select("a", "b", entity.alias("entity"), source.alias("source"), "s")
    triple = F.transform("s", lambda x: F.struct((x["rank"] - 1).alias("pid"), (F.array_position("source", x["note"]) - 1).alias("sent"), (F.array_position("entity", x["u"]) - 1).alias("e1"), (F.array_position("entity", x["v"]) - 1).alias("e2"), x["score"].alias("score"), x["sim"].alias("sim")))
    return rows.select("a", "b", "entity", "source", triple.alias("triple"))


def global_rank(df: DataFrame, key, name: str = "place") -> DataFrame:
    """Place of each row, from 1, in the order of a uniform hexadecimal key.

    No window spans the table: rows are ranked inside 4096 buckets of the key's
    first digits, after the rows of the buckets before, a table of that size.
    """
    rows = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 3))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    size = rows.groupBy("__bucket").count().select("__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", *df.columns[:1])))
    return ranked.join(F.broadcast(size), "__bucket").withColumn(name, F.col(name) + F.col("__before")).drop("__key", "__bucket", "__before")


def split(df: DataFrame, key, fractions: tuple[float, float] = (0.96, 0.98)) -> DataFrame:
    """df with ``part``: train, dev, test, cut at the floors of the fractions in a seeded order (TK7)."""
    n = df.count()
    a, b = (int(n * f) for f in fractions)
    return global_rank(df, key).withColumn("part", F.when(F.col("place") <= a, "train").when(F.col("place") <= b, "dev").otherwise("test"))


def prompt(a, b, path, sentences, no_path: bool = False, no_sent: bool = False):
    """Question and one context: a path and its sentences (SC28). Separators stay when parts are left out."""
    question = F.lower(F.concat(F.lit("entity1: "), a, F.lit(" entity2: "), b))
    way = F.lit("") if no_path else F.concat(F.lit("path: "), F.array_join(path, "; "))
    said = F.lit("") if no_sent else F.array_join(F.transform(sentences, lambda s, i: F.concat(F.lit("sentence"), (i + 1).cast("string"), F.lit(": "), s)), " ")
    return F.concat(question, F.lit(" "), way, F.lit(" "), said)


def pad_contexts(contexts, n: int):
    """The first n contexts; fewer are repeated in turn; none stays none (TK5, Q25)."""
    return F.when(F.size(contexts) == 0, contexts).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(contexts, i % F.size(contexts))))


def paragraph_cover(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """Paths (a, b, nodes) of more than two nodes that hold all other entities of a target (a, b, note, ents) (GR10)."""
    others = F.array_except("ents", F.array("a", "b"))
    joined = paths.join(targets, ["a", "b"]).withColumn("others", others)
    return joined.where((F.size("nodes") > 2) & (F.size("others") > 0) & (F.size(F.array_intersect("others", "nodes")) == F.size("others"))).drop("others")


def sole_others(targets: DataFrame) -> DataFrame:
    """(a, b, m), each once: of targets (a, b, note, ents) with one entity more than their ends, that entity. Only by it can a path of two arcs cover them."""
    others = F.array_except("ents", F.array("a", "b"))
    return targets.select("a", "b", others.alias("o")).where(F.size("o") == 1).select("a", "b", F.get("o", 0).alias("m")).distinct()
