"""Helpers that the operators share: staged tables, word counts, distributed union-find."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that removes a query's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lakelens-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are removed at its end."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def stage(df: DataFrame, tag: str, plain: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors and gives the optimiser the true size. The shuffles behind the table
    are removed once it is written. plain: values hardly repeat, so no dictionaries of them are tried.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{tag}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again: all that was made of them is staged itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "cc") -> DataFrame:
    """Connected components by distributed union-find.

    edges: pairs of long ids, in any direction, repeats allowed. Returns (id, component), component being
    the smallest id reachable; ids without an edge are not listed. Every round each node takes the least
    label among its neighbours and then that label's own label (path halving), so the rounds grow with the
    logarithm of the longest chain. Labels are staged each round; only a yes/no comes to the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = stage(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{tag}-edges")
    labels = stage(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")), f"{tag}-labels")
    while True:
        near = e.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        before, labels = labels, stage(step.join(up, "c").select("id", F.least("c", "cc").alias("component"), (F.least("c", "cc") < F.col("old")).alias("moved")), f"{tag}-labels")
        discard(before)
        if labels.where("moved").isEmpty():
            discard(e)
            return labels


def merge_components(known: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """Components (id, component) after more links (a, b): only the components that the links join are worked on."""
    side = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    x = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    x = stage(x.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), f"{tag}-joining")
    top = components(x, "ca", "cb", tag)
    new = x.select(F.col("a").alias("id")).unionByName(x.select(F.col("b").alias("id"))).distinct().join(known.select("id"), "id", "left_anti")
    every = known.select("id", "component").unionByName(new.select("id", F.col("id").alias("component")))
    out = every.join(top.select(F.col("id").alias("component"), F.col("component").alias("t")), "component", "left")
    out = stage(out.select("id", F.coalesce("t", "component").alias("component")), f"{tag}-components")
    discard(x, top)
    return out


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))


def link_buckets(entries: DataFrame, load, elements, similarity: float, tag: str, stars: int = 2, block: int = 256, parts: int = 1, spent: tuple[DataFrame, ...] = (), common=None) -> DataFrame:
    """Components (id, component) of the ids that share a bucket and whose sets have Jaccard `similarity`; no link is left out.

    entries: (bucket, id), an id at most once a bucket. load: a table (id) to (id, payload), called once with the ids that
    share a bucket at all. elements: a payload column to the array of the set's distinct elements. common: two payload
    columns to the number of elements of both, if there is a cheaper way than by `elements`. Every link is decided by the
    sets themselves. Entries, and later the members' parities, are shuffled in `parts` shares in turn, so that no
    more than one is on disk at a time; entries should then be cheap to read again. spent: staged tables that only the
    entries read, deleted as soon as those that share a bucket are known.

    In a round each bucket's members are compared with a pivot, the one that meets most others over all its buckets:
    an original meets its copies more often than they meet each other. The pivot has then met its whole bucket and
    leaves it, and buckets whose other members are in one component are done. Of what is open after `stars` rounds
    members of different components that share a base, their bucket's first pivot, are tested by parities of their
    sets, a few bits an element: these never say that linked sets differ too much, so only pairs that may be linked are
    made as rows, and the sets decide them. Tests are dealt by blocks, so that no task holds a base's members; the largest
    component beside a base is not tested with itself.
    """
    common = common or (lambda a, b: F.size(F.array_intersect(elements(a), elements(b))))
    part = similarity / (1 + similarity)  # Jaccard s: what both have is at least s / (1 + s) of the two sizes
    shares = []
    for i in range(parts):
        some = entries.where(F.pmod("bucket", F.lit(parts)) == i) if parts > 1 else entries
        # one sort counts the bucket's entries beside them; those of a large one, a few longs each, are spilled
        some = some.select("bucket", "id", F.count(F.lit(1)).over(Window.partitionBy("bucket")).alias("n"))
        shares.append(stage(some.where("n > 1"), f"{tag}-shared"))
    shared = reduce(DataFrame.unionByName, shares)
    discard(*spent)
    payload = load(shared.select("id").distinct())
    payload = stage(payload.withColumn("size", F.size(elements("payload"))), f"{tag}-payload")
    reach = shared.groupBy("id").agg((-F.sum("n")).alias("reach")).join(payload.select("id", "size"), "id")
    level = stage(shared.select("bucket", "id").join(reach, "id").withColumn("c", F.col("id")), f"{tag}-open")
    discard(*shares)
    comp = None
    held = lambda c: payload.select(F.col("id").alias(c), F.col("payload").alias(f"p{c}"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The components after the links among pairs (a, sa, ca, b, sb, cb)."""
        pairs = pairs.where((F.col("ca") != F.col("cb")) & (F.least("sa", "sb") >= F.lit(similarity) * F.greatest("sa", "sb"))).select("a", "b", "sa", "sb").distinct()
        pairs = pairs.join(held("a"), "a").join(held("b"), "b")
        pairs = stage(pairs.select("a", "b", (F.col("sa") + F.col("sb")).alias("sizes"), common("pa", "pb").alias("common")), f"{tag}-compared")
        links = pairs.where(F.col("common") >= F.lit(part - 1e-12) * F.col("sizes"))
        after = components(links, tag=tag) if comp is None else merge_components(comp, links, tag)
        discard(pairs, *([] if comp is None else [comp]))
        return after

    side = lambda s: [F.col("id").alias(s), F.col("size").alias(f"s{s}"), F.col("c").alias(f"c{s}")]
    for turn in range(stars):
        pivot = level.groupBy("bucket").agg(F.min(F.struct("reach", "id", "size", "c")).alias("p"))
        met = level.join(pivot, "bucket").where("id <> p.id")
        comp = linked(met.select(*side("a"), F.col("p.id").alias("b"), F.col("p.size").alias("sb"), F.col("p.c").alias("cb")))
        rest = met.select("bucket", "id", "size", "reach", "base" if turn else F.col("p.id").alias("base")).join(comp, "id", "left")
        rest = rest.select("bucket", "id", "size", "reach", "base", F.coalesce("component", "id").alias("c"))
        before, level = level, stage(still_open(rest), f"{tag}-open")
        discard(before)
        if level.isEmpty():
            break
    else:
        ids = level.select("id", "base", "size", "c").distinct()
        most = ids.groupBy("base", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("base").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.max("n").alias("of"))
        ids = ids.join(most.where("n > of"), "base")
        x = stage(ids.join(parities(ids.select("id").distinct().join(payload, "id"), elements), "id"), f"{tag}-beside")
        few, all_ = (F.ceil(n / block).cast("int") for n in (F.col("n") - F.col("of"), F.col("n")))
        deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        how = lambda s: [*side(s), F.col("parity").alias(f"x{s}")]
        able = F.least("sa", "sb") >= F.lit(similarity) * F.greatest("sa", "sb")
        close = apart("xa", "xb") <= F.lit(1 - 2 * part + 1e-12) * (F.col("sa") + F.col("sb"))
        fits = (F.col("ca") != F.col("cb")) & (F.col("main") | (F.col("a") < F.col("b"))) & F.when(able, close).otherwise(F.lit(False))
        found = []
        for k in range(parts):
            some = x.where(F.pmod(F.xxhash64("base"), F.lit(parts)) == k)
            a = some.where("c <> top").select("base", deal(few).alias("i"), spread(all_).alias("j"), *how("a"))
            b = some.select("base", spread(few).alias("i"), deal(all_).alias("j"), *how("b"), (F.col("c") == F.col("top")).alias("main"))
            found.append(stage(a.join(b, ["base", "i", "j"]).where(fits).select("a", "sa", "ca", "b", "sb", "cb"), f"{tag}-found"))
        discard(x)
        comp = linked(reduce(DataFrame.unionByName, found))
        discard(*found)
    discard(level, payload)
    return comp


def still_open(members: DataFrame) -> DataFrame:
    """Of (bucket, id, c, ...) the buckets that hold several components."""
    several = members.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    return members.join(several, "bucket", "left_semi")


def parities(sets: DataFrame, elements) -> DataFrame:
    """(id, payload, size) to (id, parity): as an array of longs, for every bit whether an odd number of the set's elements falls on it.

    There are at least two bits an element and 512 in all, a power of two of them, so a parity folds to half its length by exclusive or.
    The bits in which two parities differ are at most the elements that only one of the two sets has.
    """
    words = F.greatest(F.lit(8), F.pow(F.lit(2), F.ceil(F.log2(F.col("size") / 32)))).cast("int")
    x = sets.select("id", words.alias("words"), F.explode(elements("payload")).alias("h"))
    x = x.groupBy("id", "words", F.pmod(F.shiftright("h", 6), F.col("words")).cast("int").alias("w")).agg(F.bit_xor(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    x = x.groupBy("id", "words").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("at"))
    return x.select("id", F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: F.coalesce(F.element_at("at", i.cast("int")), F.lit(0).cast("long"))).alias("parity"))


def apart(a: str, b: str) -> Column:
    """In how many bits two parities differ, the longer one, of at most twice the length, folded to the shorter."""
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    x = F.when(F.size(a) > F.size(b), half(a)).otherwise(F.col(a))
    y = F.when(F.size(b) > F.size(a), half(b)).otherwise(F.col(b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)


def beside(members: DataFrame, payload: DataFrame, elements, tag: str) -> DataFrame:
    """members (id, base, size, c, ...) with (share, more, less): how a member's set differs from its base's.

    share is the number of common elements, more the member's other elements, less those of the base's. Payloads are
    shuffled and their elements, which take far more room, made where they meet.
    Two members a and b of one base have in common what neither lacks of it, share(a) - |less(b)| + |less(a) and less(b)|,
    and what both have more.
    """
    held = lambda c: payload.select(F.col("id").alias(c), F.col("payload").alias(f"p_{c}"))
    x = members.join(held("id"), "id").join(held("base"), "base")
    x = x.select(*members.columns, elements("p_id").alias("of_id"), elements("p_base").alias("of_base"))
    x = x.select(*members.columns, F.array_except("of_id", "of_base").alias("more"), F.array_except("of_base", "of_id").alias("less"))
    return stage(x.withColumn("share", F.col("size") - F.size("more")), f"{tag}-beside")


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those whose key hashes least: the same rows on every run.

    Only about 1.5 n rows pass the filter on the hash, so tasks send no more than that however many they are.
    """
    h = F.xxhash64(F.lit("sample"), F.col(key))
    total = df.count()
    if total > 2 * n:
        df = df.where(F.shiftrightunsigned(h, 33) < int(2**31 * min(1.0, (1.5 * n + 50) / total)))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")
