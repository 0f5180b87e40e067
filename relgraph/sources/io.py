"""Readers and writers of the shapes that the pipeline exchanges. Never pickle, never eval."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relgraph.sources import scratch


#: White space at the ends of lines.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def stripped(c):
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc, title, para, line): pages of an annotated dump tree (IO1, IO2).

    A page is a record that ends with its mark, so files of any size are read in pieces; doc is the page's id.
    A title goes up to the end of its tag, quotes included. Empty lines and all that equal the title are left out.
    """
    pages = spark.read.option("lineSep", "</doc>").option("recursiveFileLookup", True).text(path)
    head = r'(?s)<doc id="([^"\n]*)"[^\n]*?title="([^\n]*?)">(?:\r\n|\r|\n)?(.*)'
    part = lambda k: F.regexp_extract("value", head, k)
    pages = pages.where(F.contains("value", F.lit('<doc id="'))).select(F.col("_metadata.file_path").alias("file"), part(1).alias("doc"), stripped(F.regexp_replace(part(2), SPACE + "+", " ")).alias("title"), part(3).alias("body"))
    lines = pages.select("file", "doc", "title", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("para", "line")).withColumn("line", stripped("line"))
    return lines.where((F.col("line") != "") & (F.col("line") != F.col("title")))


def read_ids(lines: DataFrame) -> DataFrame:
    """(id, title) of page headers among lines (value) that are ASCII throughout (IO3)."""
    head = r'^<doc id="(.*?)" url=".*?title="(.*?)">'
    ascii_ = lines.where(F.col("value").rlike(head) & F.col("value").rlike(r"\A[\x00-\x7F]*\z"))
    return ascii_.select(F.regexp_extract("value", head, 1).alias("id"), F.regexp_extract("value", head, 2).alias("title"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as rows (IO4)."""
    return spark.read.text(path)


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines) of every file: its line ends and one, so a line end at the end counts an empty line more (IO9).

    Line ends are the bytes of a file beyond those of its lines; contents are read as lines only. Empty files are not listed.
    """
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length")
    said = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.sum(F.octet_length("value")).alias("said"))
    return whole.join(said, "file", "left").select("file", (F.col("length") - F.coalesce("said", F.lit(0)) + 1).alias("lines"))


def output_paths(path: str) -> dict[str, str]:
    """Where the tables of a run stand: sentences with titles, entities as found and resolved, pairs, occurrences, features (IO1)."""
    return {k: f"{path}/{k}" for k in ("sentences", "raw", "lists", "pairs", "occurrences", "features", "graph")}


def read_cooccurrence(spark: SparkSession, path: str) -> DataFrame:
    """Tab-joined entities of each line; an empty line has none (IO14)."""
    return spark.read.text(path).select(F.filter(F.split("value", "\t"), lambda x: x != "").alias("ents"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(ent, vec) of a word-vector text file, packed or not: a name without spaces and its numbers; a first line of two numbers is none (IO12)."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p")).where(F.size("p") > 2)
    return parts.select(F.replace(F.get("p", F.lit(0)), F.lit("_"), F.lit(" ")).alias("ent"), F.transform(F.slice("p", 2, F.size("p")), lambda x: x.cast("float")).alias("vec"))


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON document or array a file (IO7, IO16)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_delimited(spark: SparkSession, path: str, schema: str, delimiter: str = "\t", header: bool = False) -> DataFrame:
    """Delimited text without quoting (IO8, IO11, D20)."""
    return spark.read.schema(schema).option("sep", delimiter).option("header", header).option("quote", "").option("mode", "PERMISSIVE").csv(path)


#: Columns of a feature file that a graph needs, and their types; spans are written as (first, last).
FEATURES = {"sim": "double", "kw1": "string", "kw2": "string", "kw1_span": "span", "kw2_span": "span", "dep_path": "string", "sent": "string", "dep_coverage": "double", "pattern_freq": "double", "score": "double"}


def read_features(spark: SparkSession, path: str, columns: dict[str, str] = FEATURES) -> DataFrame:
    """Columns of delimited feature files with headers, found by name in whatever order a file has them (IO11).

    A column that no header names is an error; spans become (start, end).
    """
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    ends = lambda c: F.transform(F.regexp_extract_all(c, F.lit("-?[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    span = lambda c: F.struct(F.get(ends(c), 0).alias("start"), F.get(ends(c), 1).alias("end"))
    return rows.select(*[(span(c) if kind == "span" else F.col(c).cast(kind)).alias(c) for c, kind in columns.items()])


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, title); the header and rows of fewer columns are left out; their number is logged (IO19)."""
    rows = read_delimited(spark, path, "id string, text string, title string").where("id <> 'id'")
    short = rows.where("text is null or title is null").count()
    if short:
        logging.getLogger(__name__).warning("%d rows of %s have fewer than three columns", short, path)
    return rows.where("text is not null and title is not null")


def write_table(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    """Parquet, for graphs, counters, vectors and dictionaries alike (IO5, IO12, IO15, IO23)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """Tab-separated scalars with a header (IO10)."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One text column as lines (IO6, IO17)."""
    df.write.mode("overwrite").text(path)


def merge_lines(spark: SparkSession, parts: str, out: str) -> None:
    """One file of the lines of all text files in a folder, by file name; the folder is deleted (IO17).

    Each part is one row, so none may pass 2 GB.
    """
    rows = spark.read.text(parts, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows.orderBy("file").coalesce(1).select(F.regexp_replace("value", r"\n\z", "").alias("value")).write.mode("overwrite").text(out)
    scratch.delete(spark, parts)


def merge_json(spark: SparkSession, parts: str, out: str) -> None:
    """One table of the records of all JSON files in a folder, which is deleted (IO18)."""
    write_json(read_json(spark, parts), out)
    scratch.delete(spark, parts)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def dataset_name(sim: float, target_directed: bool, source_directed: bool, threshold: float) -> str:
    """The name of a dataset says how it was made (IO13)."""
    kind = lambda d: "dir" if d else "undir"
    return f"dataset_{sim:.2f}_{kind(target_directed)}2{kind(source_directed)}_{threshold:.2f}.json"


def split_outputs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hypotheses and references of output rows (question, output, target); a row without one of them is an error (IO20)."""
    bad = rows.where("question is null or output is null or target is null").count()
    if bad:
        raise ValueError(f"{bad} rows have fewer than three columns")
    return rows.select(F.col("output").alias("value")), rows.select(F.col("target").alias("value"))


def distinct_entities(pages: DataFrame, col: str = "title") -> DataFrame:
    return pages.select(col).where(F.col(col) != "").distinct()


def note(folder, file, line):
    """A sentence's pointer, folder:file:line (SC30)."""
    return F.concat_ws(":", folder, file, line.cast("string"))


def from_note(c):
    parts = F.split(c, ":")
    return F.struct(F.get(parts, 0).alias("folder"), F.get(parts, 1).alias("file"), F.get(parts, 2).cast("int").alias("line"))


def cypher(triples: DataFrame) -> DataFrame:
    """(command): statements that make nodes and edges (src, dst, note) once each (IO21)."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    nodes = triples.select(F.explode(F.array("src", "dst")).alias("n")).distinct().select(F.concat(F.lit("MERGE (:Entity {name: "), quoted("n"), F.lit("})")).alias("command"))
    edges = triples.distinct().select(F.concat(F.lit("MATCH (a:Entity {name: "), quoted("src"), F.lit("}), (b:Entity {name: "), quoted("dst"), F.lit("}) MERGE (a)-[:RELATED {note: "), quoted("note"), F.lit("}]->(b)")).alias("command"))
    return nodes.unionByName(edges)


def batches(df: DataFrame, n: int, *order: str) -> DataFrame:
    """df with ``batch``, groups of n rows within each value of the first order column (SC33).

    Rows are ranged by all order columns; a value may have many ranges. A row's place is that in its
    range, after the rows of the ranges before, a table of no more rows than there are values and ranges.
    """
    ranged = scratch.materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "batches")
    sizes = ranged.groupBy(order[0], "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(order[0]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n").withColumnRenamed(order[0], "__key")
    rows = ranged.join(scratch.small(sizes), F.col("__key").eqNullSafe(F.col(order[0])) & (sizes["__range"] == ranged["__range"])).drop(sizes["__range"])
    place = F.row_number().over(Window.partitionBy(order[0], "__range").orderBy(*order[1:])) + F.col("__before")
    return rows.withColumn("batch", F.floor((place - 1) / n)).select(*df.columns, "batch")


def sentences_of_pair(occurrences: DataFrame, sents: DataFrame, a, b) -> DataFrame:
    """(note, text) of the sentences (note, text) that two entities share, by the occurrence index (ent, note) (IO24)."""
    both = occurrences.where(F.col("ent").isin(a, b)).groupBy("note").agg(F.count_distinct("ent").alias("n")).where("n = 2").select("note")
    return sents.join(both, "note")
