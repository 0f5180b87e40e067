"""python -m relgraph COMMAND: the steps from text to samples, over Parquet tables and text files.

Every COMMAND reads what earlier ones wrote; -h after it lists its arguments. Graphs are tables
(src, dst, sim, data), features (kw1, kw2, sim, dep_path, note, score, ...), samples those of operators.dataset.
Parse trees and vectors are inputs, so a feature table is where the graph commands start.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.functions import text
from relgraph.operators import cooccur, dataset, extract, graph, metrics, parse, samples
from relgraph.sources import io, scratch

COMMANDS: dict[str, tuple[Callable, Callable]] = {}  # options: command line, then the file of --config, then defaults


def command(name: str, *args):
    """Register f under name; args are (flags, settings) of its arguments."""

    def add(f):
        def declare(parser):
            parser.description = f.__doc__
            for flags, settings in args:
                parser.add_argument(*flags.split(), **settings)

        COMMANDS[name] = (f, declare)
        return f

    return add


def arg(flags: str, **settings):
    return flags, settings


OUT, DIRECTED = arg("out"), arg("--directed", action="store_true")
SIM, THRESHOLD, FEATURE = arg("--sim", type=float, default=0.5), arg("--threshold", type=float, default=0.75), arg("--feature", default="score", choices=("score", "significant", "explicit", "random"))
HOPS, PATHS, SEED = arg("--hops", type=int, default=3), arg("--paths", type=int, default=5), arg("--seed", type=int, default=0)


@command("sentences", arg("dump"), OUT)
def sentences(spark: SparkSession, a) -> None:
    """Sentences (file, title, para, sent, text) of an annotated dump, link marks replaced by their text."""
    lines = io.read_dump(spark, a.dump)
    plain = F.regexp_replace("line", r'<a href="[^"]*">([^<]*)</a>', "$1")
    io.write_table(lines.select("file", "title", "para", F.posexplode(text.sentences(plain)).alias("sent", "text")), a.out)


@command("preprocess", arg("dump"), arg("vectors"), OUT, arg("--dim", type=int, default=100), arg("--tokens", default="plain", choices=("plain", "treebank")), arg("--lemmas"), arg("--learn", action="store_true"))
def preprocess(spark: SparkSession, a) -> None:
    """From a dump and vectors (ent, vec) to tables: sentences, entities as found and resolved, lists, pairs with similarity, occurrences.

    --tokens: the words that names are looked for in; --lemmas: a table (word, lemma) of nouns; --learn: sentence ends learnt from the dump.
    """
    paras = scratch.materialise(io.read_dump(spark, a.dump).select(F.concat_ws("#", "file", "doc").alias("page"), "para", "title", "line"), "paragraphs")
    vectors, at = spark.read.parquet(a.vectors), io.output_paths(a.out)
    read = lambda k: spark.read.parquet(at[k])
    sents = extract.learnt_sentences(paras) if a.learn else extract.sentences(paras)
    io.write_table(sents.withColumn("note", F.concat_ws(":", "page", "para", "sent")), at["sentences"])
    io.write_table(extract.found_entities(paras, *extract.words(read("sentences"), a.tokens, spark.read.parquet(a.lemmas) if a.lemmas else None)), at["raw"])
    io.write_table(extract.lists(extract.resolve(read("raw"), read("sentences"), vectors)), at["lists"])
    io.write_table(extract.pairs(read("lists"), vectors, a.dim), at["pairs"])
    io.write_table(cooccur.occurrences(read("lists")), at["occurrences"])
    scratch.discard(paras)


@command("features", arg("pairs"), arg("trees"), OUT, SIM)
def features(spark: SparkSession, a) -> None:
    """Feature and pattern tables of pairs (note, a, b, sim) in parsed sentences (note, tokens, head, dep); pairs of at least --sim make the counts."""
    placed = scratch.materialise(extract.tree_pairs(spark.read.parquet(a.pairs), spark.read.parquet(a.trees)), "placed")
    io.write_table(parse.patterns(placed, sim_threshold=a.sim).groupBy("kind", "pattern").agg(F.count("*").alias("cnt")), f"{a.out}/patterns")
    core, sub = (spark.read.parquet(f"{a.out}/patterns").where(F.col("kind") == k).select("pattern", "cnt") for k in ("core", "sub"))
    io.write_table(extract.feature_rows(placed, core, sub), f"{a.out}/features")
    scratch.discard(placed)


@command("cooccurrence", arg("lists"), OUT)
def cooccurrence(spark: SparkSession, a) -> None:
    """NPMI graph (a, b, c, npmi) of entity lists (note, ents)."""
    io.write_table(cooccur.npmi(spark.read.parquet(a.lists)), a.out)


@command("occurrences", arg("lists"), OUT)
def occurrences(spark: SparkSession, a) -> None:
    """Occurrence index (ent, note) of entity lists (note, ents)."""
    io.write_table(cooccur.occurrences(spark.read.parquet(a.lists)), a.out)


@command("generate_graph", arg("features"), OUT, arg("--sim", type=float, default=-1.0))
def generate_graph(spark: SparkSession, a) -> None:
    """The directed graph of a feature table."""
    io.write_table(graph.digraph(spark.read.parquet(a.features), a.sim), a.out)


@command("convert_dir_to_undir", arg("graph"), OUT)
def convert_dir_to_undir(spark: SparkSession, a) -> None:
    """One edge for each unordered pair."""
    io.write_table(graph.undirected(spark.read.parquet(a.graph)), a.out)


def _sentence_graph(spark: SparkSession, path: str, a) -> DataFrame:
    return graph.sentence_graph(graph.related(spark.read.parquet(path), a.sim), a.threshold, a.feature if a.feature != "random" else "score")


@command("generate_sent_graph", arg("graph"), OUT, SIM, THRESHOLD, FEATURE)
def generate_sent_graph(spark: SparkSession, a) -> None:
    """Related edges with the sentences that reach the threshold, best first."""
    io.write_table(_sentence_graph(spark, a.graph, a), a.out)


@command("alternate_graph_with_random_sent", arg("occurrences"), arg("graph"), OUT, SEED)
def alternate_graph_with_random_sent(spark: SparkSession, a) -> None:
    """The graph's edges with up to two shared notes each instead of scored sentences; scores are 0."""
    edges = spark.read.parquet(a.graph).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    drawn = graph.random_sentences(cooccur.shared(spark.read.parquet(a.occurrences), edges), a.seed)
    zero, span = F.lit(0.0), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    item = F.struct("k", F.struct(zero.alias("score"), "note", zero.alias("significant"), zero.alias("explicit"), span.alias("span_head"), span.alias("span_tail")).alias("x"))
    rows = drawn.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.lit(0.0).alias("sim"), F.transform(F.sort_array(F.collect_list(item)), lambda t: t["x"]).alias("data"))
    io.write_table(rows, a.out)


@command("collect_sample", arg("target"), arg("source"), OUT, SIM, THRESHOLD, HOPS, PATHS, DIRECTED, arg("--samples", type=int, default=-1, help="only the first so many"))
def collect_sample(spark: SparkSession, a) -> None:
    """Samples (JSON) of every related edge of the target graph, paths from the source graph (--directed: it is)."""
    a.feature = "score"
    found = dataset.collect_samples(_sentence_graph(spark, a.target, a), _sentence_graph(spark, a.source, a), directed=a.directed, max_hops=a.hops, path_num=a.paths, sample_num=a.samples)
    io.write_json(found, a.out)
    edges = graph.related(spark.read.parquet(a.target), a.sim).count()
    print(spark.read.json(a.out).count() / edges if edges else None)


@command("split_dataset", arg("samples"), OUT, SEED)
def split_dataset(spark: SparkSession, a) -> None:
    """Folders train, dev and test of a sample file."""
    rows = spark.read.json(a.samples)
    parts = samples.split(rows, F.md5(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"), F.lit(str(a.seed)))))
    for part in ("train", "dev", "test"):
        io.write_json(parts.where(F.col("part") == part).drop("part", "place"), f"{a.out}/{part}")


@command("rebuild_dataset", arg("samples"), arg("target"), arg("source"), OUT, FEATURE, HOPS, PATHS, DIRECTED, SEED)
def rebuild_dataset(spark: SparkSession, a) -> None:
    """Samples of the same pairs on other sentence graphs; pairs without one stay, with nulls."""
    t = spark.read.parquet(a.target)
    pairs = spark.read.json(a.samples).select(F.col("a").cast(t.schema["src"].dataType), F.col("b").cast(t.schema["dst"].dataType))
    feature = None if a.feature == "random" else a.feature
    io.write_json(dataset.collect_samples(t, spark.read.parquet(a.source), pairs=pairs, directed=a.directed, max_hops=a.hops, path_num=a.paths, feature=feature, replaceable=True, seed=a.seed, keep_failed=True), a.out)


@command("collect_paragraph", arg("graph"), arg("lists"), OUT, HOPS)
def collect_paragraph(spark: SparkSession, a) -> None:
    """Pairs and paths (a, b, note, ents, nodes) that hold all other entities of one of the pair's sentences."""
    edges = spark.read.parquet(a.graph)
    arcs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("w"))
    notes = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.explode("data.note").alias("note")).join(spark.read.parquet(a.lists), "note")
    found = graph.paths_up_to(arcs, notes.select("a", "b").distinct(), a.hops, least=2)
    io.write_table(samples.paragraph_cover(found, notes).drop("weights"), a.out)


@command("score_sent", arg("trees"), arg("core"), arg("sub"))
def score_sent(spark: SparkSession, a) -> None:
    """Mean score of parsed sentences (id, head, dep, s1, e1, s2, e2) with pattern counts (pattern, cnt)."""
    print(parse.features(spark.read.parquet(a.trees), spark.read.parquet(a.core), spark.read.parquet(a.sub)).agg(F.avg("score")).first()[0])


@command("merge_lines", arg("parts"), OUT)
def merge_lines(spark: SparkSession, a) -> None:
    """One text file of all files of a folder, by name; the folder is deleted."""
    io.merge_lines(spark, a.parts, a.out)


@command("merge_json", arg("parts"), OUT)
def merge_json(spark: SparkSession, a) -> None:
    """One table of all JSON files of a folder, which is deleted."""
    io.merge_json(spark, a.parts, a.out)


@command("split_eval", arg("outputs"), OUT)
def split_eval(spark: SparkSession, a) -> None:
    """Hypotheses and references, as lines, of tab-separated outputs (question, output, target)."""
    rows = io.read_delimited(spark, a.outputs, "question string, output string, target string")
    for name, part in zip(("output", "target"), io.split_outputs(rows), strict=True):
        io.write_lines(part, f"{a.out}/{name}")


@command("merge_output", arg("targets"), OUT, arg("--graph", nargs=2, action="append", default=[], metavar=("NAME", "PATH")), arg("--digraph", nargs=2, action="append", default=[], metavar=("NAME", "PATH")), arg("--output", nargs=2, action="append", default=[], metavar=("NAME", "PATH")))
def merge_output(spark: SparkSession, a) -> None:
    """A CSV for human readers from targets (place, a, b, target), graphs and outputs (place, line)."""
    graphs = {n: (spark.read.parquet(p), False) for n, p in a.graph} | {n: (spark.read.parquet(p), True) for n, p in a.digraph}
    sheet = dataset.review_sheet(spark.read.parquet(a.targets), graphs, {n: spark.read.parquet(p) for n, p in a.output})
    sheet.orderBy("place").drop("place").write.mode("overwrite").option("header", True).csv(a.out)


@command("score_outputs", arg("outputs"))
def score_outputs(spark: SparkSession, a) -> None:
    """BLEU, mean ROUGE-1, 2 and L, mean METEOR, exact match of tab-separated outputs (question, output, target)."""
    rows = io.read_delimited(spark, a.outputs, "question string, output string, target string")
    pairs = rows.select("question", F.col("output").alias("hyp"), F.col("target").alias("ref"))
    keyed = scratch.materialise(pairs.drop("question").withColumn("id", F.monotonically_increasing_id()), "outputs")  # questions may repeat
    print("BLEU", metrics.bleu(keyed).first()[0])
    for name, scored in (("ROUGE-1", metrics.ngram_overlap(keyed, 1)), ("ROUGE-2", metrics.ngram_overlap(keyed, 2)), ("ROUGE-L", metrics.rouge_l(keyed))):
        print(name, scored.agg(F.avg("f1")).first()[0])
    print("METEOR", metrics.meteor(keyed).agg(F.avg("score")).first()[0])
    print("EM", pairs.agg(F.avg(metrics.exact_match(F.col("hyp"), F.array("ref")).cast("double"))).first()[0])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    config = argparse.ArgumentParser(add_help=False)
    config.add_argument("--config", help="JSON file of options; those of the command line go before, the defaults after it")
    parser = argparse.ArgumentParser(prog="relgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    chosen = parser.add_subparsers(dest="command", required=True)
    first, _ = argparse.ArgumentParser(add_help=False, parents=[config]).parse_known_args(argv)
    own = json.loads(Path(first.config).read_text()) if first.config else {}
    for name, (_, declare) in COMMANDS.items():
        of = chosen.add_parser(name, parents=[config])
        declare(of)
        of.set_defaults(**{k: v for k, v in own.items() if any(k == x.dest for x in of._actions)})
    given = parser.parse_args(argv)
    COMMANDS[given.command][0](spark or SparkSession.builder.appName(f"relgraph {given.command}").getOrCreate(), given)


if __name__ == "__main__":
    main()
