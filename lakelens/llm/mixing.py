"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import stage, word_count


def sainte_lague(df: DataFrame, group: Sequence[str], votes: str, seats: str, order: Sequence[str], out: str = "quota") -> DataFrame:
    """Give each row of a group its number of the group's seats by the highest quotients votes / (2k + 1).

    With n rows of votes v summing to V and K seats, the seats a row surely gets lie below
    round(v (K - n/2) / V) and those it may get below round(v (K + n/2) / V); only the few quotients between are
    ranked, about 2n a group, however many seats there are. Rows without votes get none. order breaks ties.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    v, k = F.col(votes).cast("double"), F.col(seats).cast("double")
    total, n = F.sum(v).over(w), F.sum((v > 0).cast("long")).over(w) / 2
    at = lambda seats_: F.floor(v * F.greatest(seats_, F.lit(0.0)) / total + 0.5)
    some = v > 0
    base = (
        df.withColumn("_lo", F.when(some, F.greatest(at(k - n) - 1, F.lit(0))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_hi", F.when(some, at(k + n) + 1).otherwise(F.lit(0)).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_lo").over(w))
    )
    quotients = base.withColumn("_seat", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence("_lo", F.col("_hi") - 1))))
    ranked = quotients.withColumn("_rank", F.row_number().over(w.orderBy((v / (2 * F.col("_seat") + 1)).desc_nulls_last(), *order)))
    won = (F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_left"))).cast("long")
    return ranked.groupBy(*df.columns).agg((F.first("_lo") + F.sum(won)).alias(out))


def targets(by_source: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Add weight and target to (source, source_size): weights by code point of source, null last, repeating.

    A source's target is min(cap * size, weight * level), the level being such that targets sum to share * all
    words: what lies above a cap is shared again by weight until nothing does. There is one row a source.
    """
    every = Window.partitionBy(F.lit(0))
    placed = by_source.withColumn("place", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") - 1) % len(weights) + 1)
    x = placed.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    x = x.withColumn("_full", F.col("_cap") / F.col("weight")).withColumn("_words", F.sum("source_size").over(every) * F.lit(float(share)))
    upto = every.orderBy("_full", "place").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_caps", F.sum("_cap").over(upto)).withColumn("_rest", F.sum("weight").over(every) - F.sum("weight").over(upto))
    x = x.withColumn("_capped", F.col("_caps") + F.col("_full") * F.col("_rest") <= F.col("_words"))
    taken = F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("weight"))).over(every)
    x = x.withColumn("_level", F.when(free > 0, (F.col("_words") - taken) / free))
    return x.select("source", "source_size", "weight", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_level"))).alias("target"))


def seeded(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 64, shard_words: int = 1 << 18, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How many words a mix takes of each document: doc_id, source, size, source_size, target, shard, taken, copies.

    The mix takes `share` times all words in blocks of block_words. Blocks go to sources by the highest
    quotients of their targets, then to each source's shards (seeded hash parts of about shard_words words) by
    those of the shard's words. In a shard the documents lie in seeded order as one line of words, cut into
    blocks; the quota goes round the line block after block, so no document is taken above `cap` times and
    at most one in a shard is taken in part. copies rounds taken / size.

    Null text counts as empty and takes nothing; a null source is a source of its own, last in order; repeated
    rows and ids count each; an empty table gives an empty result; other columns are ignored. A hot source is
    cut into as many shards as its words need.
    """
    sized = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), seeded(seed, id_col).alias("key")),
        "mix-sizes",
    )
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    every = Window.partitionBy(F.lit(0))
    by_source = by_source.withColumn("_blocks", F.round(F.sum("target").over(every) / block_words).cast("long"))
    by_source = sainte_lague(by_source, [], "target", "_blocks", ["source"], "source_blocks").drop("_blocks")
    by_source = stage(by_source.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")), "mix-sources")

    shard = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards")
    s = by_source.select(F.col("source").alias("_source"), "source_size", "target", "source_blocks", "shards")
    dealt = sized.join(s, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", shard)
    line = Window.partitionBy("source", "shard")
    shards = dealt.groupBy("source", "shard", "source_blocks").agg(F.sum("size").alias("words"))
    quotas = sainte_lague(shards, ["source"], "words", "source_blocks", ["shard"]).select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "quota", "words")

    x = dealt.drop("_source").join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    start = F.sum("size").over(line.orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    x = x.withColumn("start", start).withColumn("_take", F.least(F.col("quota") * block_words, F.floor(F.col("words") * F.lit(float(cap)))).cast("long"))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("_take") / F.col("words"))).otherwise(0).cast("long")
    x = x.withColumn("_rounds", rounds).withColumn("_rest", F.col("_take") - F.col("_rounds") * F.col("words"))
    part = F.greatest(F.least(F.col("_rest") - F.col("start"), F.col("size")), F.lit(0))
    x = x.withColumn("taken", (F.col("_rounds") * F.col("size") + part).cast("long"))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return x.select("doc_id", "source", "size", "source_size", "target", "shard", "taken", copies.alias("copies"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row as many times as the mix takes it, to the nearest whole copy.

    Rows that share an id share their copies by the seeded order, so the join is on id and size.
    """
    plan = mix(docs, **options).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "copies", F.col("source").alias("_src"))
    plan = plan.groupBy("_id", "_size", "_src").agg(F.max("copies").alias("copies"))
    x = docs.withColumn("_n", word_count(F.col("text")))
    x = x.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_size")) & F.col("source").eqNullSafe(F.col("_src")))
    return x.where("copies > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('7:' || coalesce(cast(doc_id as varchar), '')) as key from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) as place from s0),
s2 as (select *, cast([3, 1, 2][(place - 1) % 3 + 1] as double) as weight, source_size * 2e0 as cap from s1),
s3 as (select *, cap / weight as fill, (sum(source_size) over ())::double * 1.5e0 as words from s2),
s4 as (select *, sum(cap) over (order by fill, place rows unbounded preceding) + fill *
       (sum(weight) over () - sum(weight) over (order by fill, place rows unbounded preceding)) <= words as capped from s3),
s5 as (select *, (words - coalesce(sum(cap) filter (capped) over (), 0)) / nullif(coalesce(sum(weight) filter (not capped) over (), 0), 0) as level from s4),
s6 as (select source, source_size, case when capped then cap else least(cap, weight * level) end as target from s5),
k as (select cast(round(sum(target) / 64) as bigint) as blocks from s6),
q as (select source, target / (2 * seat + 1) as quotient
      from (select source, target, unnest(range(0, cast(ceil(target / 64) as bigint) + 30)) as seat from s6 where target > 0)),
b as (select source, count(*) as blocks from (select *, row_number() over (order by quotient desc, source nulls last) as r from q) where r <= (select blocks from k) group by source),
s as (select s6.*, coalesce(b.blocks, 0) as source_blocks, greatest(cast(ceil(source_size / 262144e0) as bigint), 1) as shards
      from s6 left join b on s6.source is not distinct from b.source),
x as (select d.*, s.source_size, s.target, s.source_blocks, ('0x' || substr(key, 1, 8))::bigint % s.shards as shard
      from d join s on d.source is not distinct from s.source),
h as (select source, shard, any_value(source_blocks) as source_blocks, cast(sum(size) as bigint) as words from x group by source, shard),
hq as (select source, shard, words * 1e0 / (2 * seat + 1) as quotient, source_blocks
       from (select *, unnest(range(0, source_blocks)) as seat from h where words > 0)),
hb as (select source, shard, count(*) as quota from (select *, row_number() over (partition by source order by quotient desc, shard) as r from hq)
       where r <= source_blocks group by source, shard),
y as (select x.*, h.words, least(coalesce(hb.quota, 0) * 64, 2 * h.words) as take,
        cast(sum(size) over (partition by x.source, x.shard order by key, doc_id, size rows unbounded preceding) as bigint) - size as start
      from x join h on x.source is not distinct from h.source and x.shard = h.shard
      left join hb on x.source is not distinct from hb.source and x.shard = hb.shard)
select doc_id, size, source_size, target,
  cast(case when words > 0 then (take // words) * size + greatest(least(take - (take // words) * words - start, size), 0) else 0 end as bigint) as taken
from y
"""
