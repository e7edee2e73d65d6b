"""Prefix trie of conversations: partial tries merged by hash-keyed rounds, then rolled up from the ends.

A node is known by its depth and a 128-bit digest of the turns that lead to it: the exclusive or, over positions, of
hashes of (position, role, text). Prefix digests are therefore prefix sums, so a conversation of any length is cut into
blocks, and no row ever carries a path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import discard, stage, word_count

#: Turns of a conversation whose prefix digests one task group computes; ids of one piece of an end list.
BLOCK, PIECE = 512, 1024
NODE = ["depth", "k1", "k2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def content(role: Column, text: Column) -> Column:
    """128 bits of a turn's role and text; null counts as empty."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.sha2(blank(role), 256), blank(text)), 256)), 1, 16)


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, content, words) staged: the turns of each conversation counted from 1, ordered by turn (null first).

    Turns of equal number are ordered by role, then by the digest of role and text. Ranges of the sorted turns are
    counted where they lie; a conversation that spans ranges is continued by the counts of the ranges before, of which
    there is at most one a range. Texts are not shuffled.
    """
    x = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content(F.col(role), F.col(text)).alias("content"), word_count(F.col(text)).alias("words")
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("content")]
    # Equal rows are told apart by their hash's own row number in the scan, so a range can end between them.
    x = x.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            c = b.column(0).to_numpy()
            if not len(c):
                continue
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            at = np.arange(len(c)) - np.repeat(first, np.diff(np.r_[first, len(c)])) + 1
            if c[0] == last:
                at[: first[1] if len(first) > 1 else len(c)] += n
            last, n = c[-1], at[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int64()), b.column(1), b.column(2), b.column(3)], ["conv", "at", "content", "words", "part"])

    x = x.select("conv", "content", "words", F.spark_partition_id().alias("part")).mapInArrow(count, "conv long, at long, content binary, words long, part int")
    x = stage(x, "trie-ranges")
    sizes = x.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("before", before).where("before is not null").select("conv", "part", "before")  # at most one row a range
    out = stage(x.join(F.broadcast(later), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "content", "words"), "trie-turns")
    discard(x)
    return out


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of another: (conv, depth, content, words), and (conv, length) of every one.

    Conversation c starts with the first h turns of c - c % every (all if there are fewer, none if it is absent) and
    goes on with its own after its first h; h = crc32(decimal c) % heads.
    """
    convs = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    first = turns.where((F.col("conv") % every == 0) & (F.col("pos") < heads)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "content", "words"))).alias("head"))
    c = convs.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % every)
    c = c.join(first.withColumnRenamed("conv", "base"), "base", "left")
    c = c.withColumn("head", F.filter(F.coalesce("head", F.array().cast("array<struct<pos:bigint,content:binary,words:bigint>>")), lambda t: t["pos"] <= F.col("h")))
    c = stage(c.select("conv", "own", "h", "head", F.size("head").cast("long").alias("given")), "trie-convs")
    start = c.select("conv", F.inline("head")).select("conv", F.col("pos").alias("depth"), "content", "words")
    rest = turns.join(c.select("conv", "h", "given"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "content", "words")
    return start.unionByName(rest), c.select("conv", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, words, upto, length) staged: a row for each conversation and prefix, the empty one included.

    k1 and k2 are the prefix's digest, words those of its last turn, upto those of all its turns.
    """
    x = turns.select("conv", "depth", "words", F.xxhash64(F.lit(1), "depth", "content").alias("k1"), F.xxhash64(F.lit(2), "depth", "content").alias("k2"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    whole = x.groupBy("conv", "block").agg(F.bit_xor("k1").alias("b1"), F.bit_xor("k2").alias("b2"), F.sum("words").alias("bw"))
    prior = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv", "block", *[F.coalesce(f(c).over(prior), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "b1"), (F.bit_xor, "b2"), (F.sum, "bw"))])
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("conv", "block", "depth", "words", *[f(c).over(inside).alias(n) for f, c, n in ((F.bit_xor, "k1", "k1"), (F.bit_xor, "k2", "k2"), (F.sum, "words", "upto"))])
    x = x.join(whole, ["conv", "block"]).select("conv", "depth", F.col("k1").bitwiseXOR(F.col("b1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("b2")).alias("k2"), "words", (F.col("upto") + F.col("bw")).alias("upto"))
    nought = F.lit(0).cast("long")
    top = lengths.select("conv", *[nought.alias(c) for c in ("depth", "k1", "k2", "words", "upto")])
    return stage(x.unionByName(top).join(lengths, "conv"), "trie-paths")


def merge(tries: DataFrame, sums: list[Column], again: list[Column], fan: tuple[int, ...] = (16,)) -> DataFrame:
    """Merge partial tries to one row a node.

    Every partition first combines the nodes it holds (Spark's map-side aggregation by `sums`); rounds keyed by node
    and part of the partitions combine those by `again`, until a last round by node is left. No round reads more than
    one row a node from a task of the round before.
    """
    x = tries.withColumn("part", F.spark_partition_id())
    for i, n in enumerate(fan):
        x = x.withColumn("part", F.col("part") % n).groupBy(*NODE, "part").agg(*(again if i else sums))
    return x.groupBy(*NODE).agg(*(again if fan else sums))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end.

    End lists are held in pieces of ids that agree but for their last ten bits, so a piece has at most PIECE ids however
    many conversations are equal. Lists of one piece are hashed where they are; the pieces of longer ones, in order,
    stream through one digest, which is the only way SHA-256 can be computed.
    """
    piece = F.floor(F.col("conv") / PIECE).alias("piece")
    x = ends.groupBy(*NODE, piece).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    x = stage(x.select(*NODE, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")), "trie-ends")
    n = x.groupBy(*NODE).agg(F.count(F.lit(1)).alias("pieces"), F.min("ids").alias("ids"))
    one = n.where("pieces = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        done = lambda: pa.RecordBatch.from_pylist([dict(zip(NODE, at), ends_sha256=digest.hexdigest())])
        for b in batches:
            for *node, ids in zip(*[b.column(c).to_pylist() for c in (*NODE, "ids")]):
                if node != at:
                    if at is not None:
                        yield done()
                    at, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if at is not None:
            yield done()

    many = x.join(n.where("pieces > 1").select(*NODE), NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    out = stage(one.unionByName(many.mapInArrow(stream, "depth long, k1 long, k2 long, ends_sha256 string")), "trie-digests")
    discard(x)
    return out


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of conversations given as turns (conv, depth, content, words) and lengths (conv, length).

    One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Each node belongs to its smallest member; a conversation owns the last stretch of its own path, or nothing. So what
    is counted once a node below v is a sum over the members of v of what each owns from v's depth on: a suffix sum
    along the member's path, rolled up from its end, which merging adds up. Levels need no rounds of their own, and the
    longest conversation does not set the number of jobs.
    """
    p = paths(turns, lengths)
    end = (F.col("depth") == F.col("length")).cast("long")
    first = [F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.sum(end).alias("ends"), F.max("words").alias("words")]
    again = [F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max("words").alias("words")]
    nodes = stage(merge(p, first, again), "trie-nodes")
    owner = nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.sum("words").alias("owned"), F.max((F.col("n") == F.col("ends")).cast("long")).alias("leaf"))
    above = p.join(owner.select("conv", "top"), "conv").where("depth = top - 1").select("conv", *NODE)  # where the owned stretch hangs
    # All stretches that start with a first turn of their own hang on the root, whose owner is the smallest of all.
    root = nodes.where("depth = 0").select("conv").first()
    hang = above.where("depth > 0").join(nodes.select(*NODE, F.col("conv").alias("above")), NODE).select("conv", "above")
    hang = stage(hang.unionByName(above.where("depth = 0").select("conv", F.lit(root and root.conv).cast("long").alias("above"))), "trie-hang")
    known = stage(owner.join(hang, "conv", "left"), "trie-owners")
    total = p.groupBy("conv").agg(F.max("upto").alias("total"))
    x = p.join(known.join(total, "conv", "right"), "conv")
    below = F.col("total") - F.col("upto") + F.col("words")
    saved = F.greatest(below - F.coalesce("owned", F.lit(0)), F.lit(0))
    child = ((F.col("depth") + 1 >= F.col("top")) & (F.col("depth") < F.col("length"))).cast("long")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("above"))
    sums = [("n_convs", F.lit(1)), ("n_children", F.coalesce(child, F.lit(0))), ("n_leaves", F.coalesce("leaf", F.lit(0))), ("saved_tokens", saved)]
    one = F.struct("conv", parent.alias("parent")).alias("top")
    full = merge(x, [*[F.sum(c).cast("long").alias(n) for n, c in sums], F.min(one).alias("top")], [*[F.sum(n).alias(n) for n, _ in sums], F.min("top").alias("top")])
    digests = end_digests(p.where("depth = length").select("conv", *NODE))
    return full.join(digests, NODE, "left").select(
        F.col("top.conv").alias("conv_id"), "depth", F.col("top.parent").alias("parent_conv_id"), *[n for n, _ in sums], F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the conversations rebuilt with shared heads, one row a node (see `trie` and `rebuilt`).

    Null role or text counts as empty; rows with a null conv_id belong to no conversation; a null turn comes first;
    equal turn numbers are ordered by role and digest; repeated rows are turns of their own; empty and very long texts
    are turns like others; other columns are ignored. A conversation without rebuilt turns ends at the root. An empty
    table has no node, not even the root.
    """
    t = numbered(conversations)
    return trie(*rebuilt(t))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(sha256(coalesce(role, '')) || coalesce(text, ''))) as pos
    from conversations where conv_id is not null),
-- crc32 bit by bit, as DuckDB has none: the decimal's bytes are its character codes
crc as (
  with recursive s as (select distinct c, cast(c as varchar) as d, 0 as i, 4294967295::bigint as v from t
    union all select c, d, i + 1, list_reduce(list_prepend(xor(v, ascii(d[i + 1])), range(8)), lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) from s where i < length(d))
  select c, xor(v, 4294967295) % 4 as h from s where i = length(d)),
n as (select c, max(pos) as own from t group by c),
k as (select crc.c, h, own, coalesce((select own from n b where b.c = crc.c - crc.c % 20), 0) as base_own from crc join n using (c)),
r as (select k.c, t.pos as d, role, text from k join t on t.c = k.c - k.c % 20 and t.pos <= k.h
  union all select k.c, t.pos - k.h + least(k.h, k.base_own), role, text from k join t on t.c = k.c and t.pos > k.h),
p0 as (select c, d, cast(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as bigint) as w,
    sha256(string_agg(sha256(sha256(role) || sha256(text)), '') over (partition by c order by d)) as key from r),
p as (select * from p0 union all select c, 0, 0, '' from k),
len as (select c, max(d) as len from p group by c),
nodes as (select d, key, min(c) as c, count(*) as n, max(w) as w, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (d = len), '') as ends
  from p join len using (c) group by d, key),
kids as (select q.d, q.key, count(*) as kids from nodes v join p q on q.c = v.c and q.d = v.d - 1 group by q.d, q.key),
full_ as (select nodes.*, coalesce(kids, 0) as kids from nodes left join kids on nodes.d = kids.d and nodes.key = kids.key),
sub as (select q.d, q.key, sum((v.n - 1) * v.w) as saved, count(*) filter (v.kids = 0) as leaves
  from full_ v join p q on q.c = v.c and q.d <= v.d group by q.d, q.key)
select v.c as conv_id, cast(v.d as bigint) as depth, up.c as parent_conv_id, v.n as n_convs, v.kids as n_children, leaves as n_leaves,
  cast(saved as bigint) as saved_tokens, sha256(v.ends) as ends_sha256
from full_ v join sub on sub.d = v.d and sub.key = v.key
left join p q on q.c = v.c and q.d = v.d - 1 left join nodes up on up.d = q.d and up.key = q.key
"""
