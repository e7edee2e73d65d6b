"""Fuzzy line dedup by MinHash over character shingles. DataFrame functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import discard, link_buckets, stage

#: Characters of a shingle.
SHINGLE = 5
#: Coordinates of a signature, ways to group them into bands and coordinates of a band, for long and for short lines.
LONG, BRIEF = (42, 4, 7), (48, 6, 6)
#: Shares of the bands, and of the lines that stay open, that are shuffled in turn.
PARTS = 2
#: Lines of fewer shingles than this are short and have more bands. Shingles of a short line that one row of the aggregation
#: takes together (of many more the code grows too long to be compiled), and those that are cut from one block of a line.
SHORT, STEP, BLOCK = 64, 2, 64


def chars_of(lines: DataFrame) -> DataFrame:
    """(id, line) to (id, chars, last): the line in UTF-32, where each character has its place, and its last shingle's number."""
    x = lines.select("id", F.encode("line", "UTF-32").alias("chars"))
    return x.withColumn("last", F.greatest((F.length("chars") / 4).cast("int") - SHINGLE, F.lit(0)))


def shingle_at(i: Column) -> Column:
    """The hash of a shingle; a line shorter than SHINGLE is one."""
    return F.xxhash64(F.substring("chars", i * 4 + 1, F.lit(4 * SHINGLE)))


def signatures(lines: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(id, line) to (id, bands): keys of the bands of the MinHash signature of all the line's shingles.

    One permutation serves all coordinates of a long line: its shingle hashes are dealt to the coordinates, each being the
    least of its share, or null; a shingle then changes one minimum, not all. Short lines have too few hashes to deal, so
    there a coordinate is the least of all shingles after another hash. Bands are groups of coordinates, by the ways of LONG
    or BRIEF. Lines near the border are signed both ways.
    Minima are aggregates, which Spark compiles; lambdas over arrays it would interpret.
    """
    x = chars_of(lines)
    return dealt(x.where(F.col("last") + 1 >= SHORT * similarity)).unionByName(mixed(x.where(F.col("last") + 1 < SHORT)))


def dealt(x: DataFrame) -> DataFrame:
    """(id, chars, last) to (id, bands) of long lines."""
    n = LONG[0]
    x = x.select("id", "chars", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i")).select("id", shingle_at(F.col("i")).alias("h"))
    x = x.withColumn("k", F.pmod("h", F.lit(n)).cast("int"))
    x = x.groupBy("id").agg(*[F.expr(f"min(h) filter (where k = {k})").alias(f"m{k}") for k in range(n)])
    return banded(x, *LONG)


def mixed(x: DataFrame) -> DataFrame:
    """(id, chars, last) to (id, bands) of short lines; shingles come in rows of STEP."""
    x = x.select("id", "chars", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("i"))
    x = x.select("id", *[shingle_at(F.least(F.col("i") + j, F.col("last"))).alias(f"h{j}") for j in range(STEP)])
    x = x.groupBy("id").agg(*[F.min(F.least(*[F.xxhash64(f"h{j}", F.lit(k)) for j in range(STEP)])).alias(f"m{k}") for k in range(BRIEF[0])])
    return banded(x, *BRIEF)


def banded(x: DataFrame, coordinates: int, ways: int, rows: int) -> DataFrame:
    """(id, m0, m1, ...) to (id, bands), distinct ones; those without a minimum are left out, for lines would meet by what they lack."""
    rng = random.Random(7)
    orders = [list(range(coordinates))] + [rng.sample(range(coordinates), coordinates) for _ in range(ways - 1)]
    bands = [order[i : i + rows] for order in orders for i in range(0, coordinates, rows)]
    key = lambda b, band: F.xxhash64(F.lit(1000 * ways + b), *[f"m{k}" for k in band])
    keys, lacking = F.array(*[key(b, band) for b, band in enumerate(bands)]), F.array(*[key(b, []) for b in range(len(bands))])
    return x.select("id", F.array_except(keys, lacking).alias("bands"))


def shingles(line: Column | str) -> Column:
    """A line's distinct shingles as hashes of 64 bits.

    They are cut from blocks of BLOCK of them: to find a place in a string Spark counts from its start.
    """
    line = F.col(line) if isinstance(line, str) else line
    blocks = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE},{BLOCK + SHINGLE - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    cut = lambda block: F.transform(F.sequence(F.lit(1), F.length(block) - (SHINGLE - 1)), lambda i: F.xxhash64(F.substring(block, i, F.lit(SHINGLE))))
    return F.array_distinct(F.when(F.length(line) < SHINGLE, F.array(F.xxhash64(line))).otherwise(F.flatten(F.transform(blocks, cut))))


def grams(line: Column | str) -> Column:
    """The hashes of a line's shingles, one for each place: as many distinct ones as `shingles`, in less than half its time.

    They are cut from the line in UTF-32, which a lambda's variable holds: as an alias it would be made anew for every shingle.
    """
    line = F.col(line) if isinstance(line, str) else line
    places = lambda chars: F.sequence(F.lit(1), F.greatest(F.length(chars) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))
    cut = lambda chars: F.transform(places(chars), lambda i: F.xxhash64(F.substring(chars, i, F.lit(4 * SHINGLE))))
    return F.element_at(F.transform(F.array(F.encode(line, "UTF-32")), cut), 1)


def text_key(text: Column) -> Column:
    """With the id, the row's key: rows of one id (or of none) and different texts are told apart. Null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, line_no, line, id): id is the trimmed line's hash, null for blank lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the text's hash is made once, before its lines are rows, which then need not carry the text
    x = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_hash"), F.split(text, "\n", -1).alias("raws"))
    x = x.select("doc_id", "text_hash", F.posexplode("raws").alias("line_no", "raw"))
    x = x.withColumn("line", F.btrim("raw", F.lit(" \t\r")))
    return x.withColumn("id", F.when(F.col("line") != "", F.xxhash64("line")))


def line_classes(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component, first_doc, first_text, first_line) of the lines that are not alone: their class and the place where it first occurs.

    Equal lines (trimmed) share an id, counted before any comparison, so a line that fills a third of the table is
    one entry. Lines whose sets of runs of SHINGLE characters have Jaccard similarity of at least `similarity` are
    linked, found by banded MinHash over those same sets and verified on the whole sets; classes are the components of the links.
    """
    lines = split_lines(docs, id_col, text_col).where("id is not null")
    place = F.struct(F.col("doc_id").isNull().alias("_n"), "doc_id", "text_hash", "line_no", "line")
    where = lines.groupBy("id").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    where = stage(where.select("id", F.col("place").dropFields("line").alias("place"), "n", "place.line"), "lines-ids", plain=True)
    signed = stage(signatures(where.select("id", "line"), similarity), "lines-bands", plain=True)
    entries = signed.select(F.explode("bands").alias("bucket"), "id")
    load = lambda ids: where.select("id", F.col("line").alias("payload")).join(ids, "id", "left_semi")
    common = lambda a, b: F.size(F.array_intersect(grams(a), grams(b)))
    comp = link_buckets(entries, load, lambda line: F.array_distinct(grams(line)), similarity, "lines", parts=PARTS, spent=(signed,), common=common)
    # a line that occurs once and is in no class is its own first place: nothing more to say of it
    x = where.select("id", "place", "n").join(comp, "id", "left").where("n > 1 or component is not null")
    x = x.select("id", F.coalesce("component", "id").alias("component"), "place")
    least = x.groupBy("component").agg(F.min("place").alias("first"))
    out = x.join(least, "component").select("id", "component", F.col("first.doc_id").alias("first_doc"), F.col("first.text_hash").alias("first_text"), F.col("first.line_no").alias("first_line"))
    out = stage(out, "lines-classes")
    discard(where, comp)
    return out


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document (doc_id, text_hash): n_lines, n_removed, removed (numbers of the lines to drop, sorted), kept_hash.

    A line stays if it is blank or the first of its class by document id (null last), text_hash and line number. Null
    text counts as one blank line. Rows of the same id and text count as one document, those of the same id (or none)
    and different texts are documents of their own; an empty table gives an empty result.
    """
    classes = line_classes(docs, id_col=id_col, text_col=text_col, **options)
    lines = split_lines(docs, id_col, text_col).select("doc_id", "text_hash", "line_no", "id")
    # blank lines have no class; a key of their own keeps them from meeting in one task
    lines = lines.withColumn("key", F.coalesce("id", F.xxhash64(F.lit("blank"), "doc_id", "text_hash", "line_no")))
    x = lines.join(classes.withColumnRenamed("id", "key"), "key", "left")
    first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_hash") == F.col("first_text")) & (F.col("line_no") == F.col("first_line"))
    x = x.withColumn("gone", F.coalesce(F.col("component").isNotNull() & ~first, F.lit(False)))
    return x.groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("gone").alias("n_removed"),
        F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("line_no")))).alias("removed"),
        F.sum(F.when(~F.col("gone"), F.xxhash64("id", "line_no") % 1000000007)).alias("kept_hash"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the lines that removed_lines names; documents that had lines and lose all that are not blank go."""
    gone = removed_lines(docs, id_col, text_col, **options).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "removed")
    x = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_id")) & (text_key(F.col(text_col)) == F.col("_hash")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "removed")
    text = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    x = x.withColumn("_text", text).where(F.col("removed").isNull() | (F.btrim("_text", F.lit(" \t\r\n")) != ""))
    return x.select(*[F.col("_text").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
