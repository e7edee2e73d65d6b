"""Source divergence audit: which sources of a language differ, and by which terms. Exact integers throughout.

Count vectors are packed by chunks of the vocabulary. A task holds one chunk span of two blocks of groups and gives the
submatrix of their pairs; spans are added by Spark, so neither a language nor a source is ever in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import discard, stage

#: Terms of a chunk, chunks of a span, groups of a block.
CHUNK, SPAN, BLOCK = 4096, 8, 32
#: Entries a partition holds before it hands its counts on, and bytes of a text that are split at a time.
HELD, PIECE = 400_000, 1 << 22
#: Letters lower-cased, all that is no term made space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000


def pieces(text: bytes) -> Iterator[bytes]:
    """The folded text in pieces of about PIECE bytes, cut only between terms."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(b" ", at + 1, at + PIECE)
        cut = text.find(b" ", at + PIECE) if cut < 0 else cut
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, tf, df), combined within the partition; a group itself has the empty term."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (tf, df) in held.items():
            terms = list(tf)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([tf[t] for t in part], pa.int64()), pa.array([df[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "tf", "df"],
                )

    for b in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in b.columns]):
            tf, df = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            before = len(tf)
            folded = text.translate(FOLD)
            if len(folded) <= PIECE:
                terms = folded.split()
                tf.update(terms)
                df.update(set(terms))
            else:
                own: set[bytes] = set()
                for piece in pieces(folded):
                    terms = piece.split()
                    tf.update(terms)
                    own.update(terms)
                df.update(own)
            size += len(tf) - before
            if size > HELD:
                yield from out()
                held, size = {}, 0
    yield from out()


def probabilities(count: np.ndarray, n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), digit by digit, so that nothing exceeds 64 bits."""
    total = n + 2 * v
    rest = count + 2  # at most the total
    out = rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def p_column(count: Column, n: Column, v: Column) -> Column:
    """The same in Spark, by decimals of 38 digits."""
    whole = lambda c: c.cast("decimal(38,0)")
    q = F.call_function("div", whole((count + 2).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")), whole(n + 2 * v))
    return q + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def tile(lang: str, rows: pa.Table) -> Iterator[tuple[str, str, str, int]]:
    """The pairs of a tile with their sums over its chunks: rows (source, block, chunk, width, n, v, at, tf) of one or two blocks."""
    block = rows["block"].to_numpy()
    names = rows["source"].to_pylist()
    blocks = sorted(set(block.tolist()))
    sums: dict[tuple[str, str], int] = {}
    chunks = rows["chunk"].to_numpy()
    for chunk in sorted(set(chunks.tolist())):
        where = np.flatnonzero(chunks == chunk)
        width = rows["width"][int(where[0])].as_py()
        p = np.zeros((len(where), width), np.int64)
        for i, r in enumerate(where.tolist()):
            p[i, rows["at"][r].values.to_numpy()] = rows["tf"][r].values.to_numpy()
        n, v = (rows[c].to_numpy()[where][:, None] for c in ("n", "v"))
        p = probabilities(p, n, v)
        side = [[i for i, r in enumerate(where.tolist()) if block[r] == b] for b in blocks]
        right = side[-1]
        for i in side[0]:
            others = [j for j in right if len(blocks) == 2 or names[where[j]] > names[where[i]]]
            if others:
                for j, s in zip(others, gap(p[others], p[i]).sum(1).tolist()):
                    pair = (names[where[i]], names[where[j]])
                    sums[pair] = sums.get(pair, 0) + s
    for (a, b), s in sums.items():
        yield lang, a, b, s


def counts_of(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, tf, df) staged: occurrences and documents of each term in each group; the empty term marks the group."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    x = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).cast("binary").alias("text"))
    x = x.mapInArrow(counted, "lang string, source string, term string, tf long, df long")
    return stage(x.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")), "divergence-counts")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """The divergences of the sources of each language: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; those in at least `least_docs`
    documents of a language are kept. Part `pair` has every other source of the language with the summed divergence over
    the kept terms; part `term` has the `top` kept terms that a group uses more than its language does.

    Null text, lang and source count as empty strings; a group whose texts have no term still has its pairs; a language
    without kept terms has value 0 for all of them; repeated rows count as often as they occur; ties rank by the item's
    UTF-8 bytes; long texts are counted in pieces cut between terms; other columns are ignored; an empty table has no rows.
    """
    counts = counts_of(docs)
    words = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where(F.col("df") >= least_docs)
    langs = counts.select("lang").distinct()
    size = words.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("tf").alias("ln"))
    langs = stage(langs.join(size, "lang", "left").select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "ln")], F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / CHUNK), F.lit(1)).alias("chunks")), "divergence-langs")
    # Chunks are hash classes of the language's terms; within one, terms are numbered.
    words = words.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    words = words.withColumn("at", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).cast("int"))
    words = stage(words.select("lang", "term", "chunk", "at", F.col("tf").alias("lang_tf"), "v", "ln"), "divergence-words")
    kept = stage(counts.where("term <> ''").select("lang", "source", "term", "tf").join(words, ["lang", "term"]), "divergence-kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("tf").alias("n"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang")
    groups = stage(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "v", "ln", "chunks"), "divergence-groups")
    discard(counts)

    # Part `term`.
    x = kept.join(groups.select("lang", "source", "n"), ["lang", "source"])
    p, q = p_column(F.col("tf"), F.col("n"), F.col("v")), p_column(F.col("lang_tf"), F.col("ln"), F.col("v"))
    x = x.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    f = F.expr("(p - q) * (p - q) div (p + q)")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = x.select("lang", "source", F.lit("term").alias("part"), "item", f.alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Part `pair`: blocks of groups by hash, every chunk of a group in a row, replicated to the tiles of its block.
    count = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    g = groups.join(count, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    g = g.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    packed = kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "tf")).alias("row"))
    widths = words.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("width"))
    g = g.join(widths, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    g = g.withColumn("other", other).select(
        "lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.floor(F.col("chunk") / SPAN).alias("span"), "source", "block", "chunk", F.coalesce("width", F.lit(0)).alias("width"), "n", "v",
        F.coalesce("row.at", F.array().cast("array<int>")).alias("at"), F.coalesce("row.tf", F.array().cast("array<bigint>")).alias("tf"),
    )

    def pairs(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lang, i, j = (k.as_py() for k in key[:3])
        lone = i != j and len(rows["block"].unique()) < 2  # the other block has no group
        found = [] if lone else list(tile(lang, rows))
        return pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "a", "b", "value"])

    parts = g.groupBy("lang", "i", "j", "span").applyInArrow(pairs, "lang string, a string, b string, value long")
    sums = stage(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence-pairs")
    both = sums.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.lit("pair").alias("part"), F.col("a").alias("item"), "value"))
    return both.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as tf, count(distinct r) as df from t group by all),
w as (select lang, term, sum(tf)::hugeint as tf from c group by lang, term having sum(df) >= 10),
l as (select lang, coalesce(v, 0)::hugeint as v, coalesce(n, 0)::hugeint as n from (select distinct lang from d) left join (select lang, count(*) as v, sum(tf) as n from w group by lang) using (lang)),
k as (select g.lang, g.source, w.term, coalesce(c.tf, 0)::hugeint as tf from (select distinct lang, source from d) g join w on w.lang = g.lang
  left join c on c.lang = g.lang and c.source = g.source and c.term = w.term),
p as (select lang, source, term, tf, 1 + (1000000000::hugeint * (tf + 2)) // (sum(tf) over (partition by lang, source) + 2 * l.v)::hugeint as p from k join l using (lang)),
q as (select w.lang, w.term, 1 + (1000000000::hugeint * (w.tf + 2)) // (l.n + 2 * l.v) as q from w join l using (lang)),
g as (select distinct lang, source from d),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p join q using (lang, term) where tf > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::int as rank from r where part = 'pair' or rank <= 10
"""
