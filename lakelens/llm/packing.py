"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import stage, word_count

CAPACITIES = (512, 1024, 2048, 4096, 8192)
COPIES = 4096


def best_fit(lengths: Sequence[int], capacities: Sequence[int], attention: float) -> tuple[list[int], list[int], list[int]]:
    """Pack lengths, given longest first, and return each one's bin and offset and each bin's final capacity.

    Each item goes to the open bin whose free space it leaves smallest. If none has room, a bin opens at the
    least-cost size for a bin meant to hold `ahead` times the item; the sizes are optimised together by trying
    each such policy over the whole shard and keeping the one of least total cost, a bin of capacity c costing
    c (1 + attention c), after every bin is downsized to the smallest permitted length that holds its contents.
    """
    cost = {c: c * (1 + attention * c) for c in capacities}
    best = None
    for ahead in (1, 2, 4, capacities[-1]):
        free: list[tuple[int, int]] = []  # (space, bin), sorted
        bins, offsets, used = [], [], []
        for n in lengths:
            i = bisect_left(free, (n, -1))
            if i < len(free):
                space, b = free.pop(i)
            else:
                want = min(n * ahead, capacities[-1])
                b, space = len(used), min((c for c in capacities if c >= want), key=lambda c: cost[c] / min(c, want))
                used.append(0)
            bins.append(b)
            offsets.append(used[b])
            used[b] += n
            if space > n:
                insort(free, (space - n, b))
        final = [capacities[bisect_left(capacities, u)] for u in used]
        if best is None or sum(cost[c] for c in final) < best[0]:
            best = (sum(cost[c] for c in final), bins, offsets, final)
    return best[1:]


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, shard_pieces: int = 4096, attention: float = 1 / 8192, end_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every word of every document: doc_id, piece, start, length, shard, bin, capacity, offset.

    A document's length is its words plus end_words (the end mark). Those longer than the largest capacity are
    cut into pieces of that capacity and a rest; start is the piece's first word. Pieces are dealt by hash into
    shards of about shard_pieces, each packed by best_fit in one task. Equal rows are counted first, then numbered
    in spans of COPIES and dealt by their number as well, so a group is bounded however repetitive the table is and
    the dealing does not depend on partitions. (shard, bin) names a bin; its pieces lie at offset without overlap.

    Null and empty texts are a piece of end_words; with end_words = 0 they have none. Rows that repeat are packed
    each; an empty table gives an empty result; other columns are ignored.
    """
    capacities = sorted({int(c) for c in capacities})
    most = capacities[-1]
    sized = docs.select(F.col(id_col).alias("doc_id"), (word_count(F.col(text_col)) + end_words).alias("_n"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"))
    equal = sized.where("_n > 0").groupBy("doc_id", "_n", "_h").agg(F.count("*").alias("_rows"))
    equal = stage(equal, "pack-lengths")
    total = equal.agg(F.sum(F.col("_rows") * F.ceil(F.col("_n") / most))).first()[0] or 0
    spans = equal.withColumn("_span", F.explode(F.sequence(F.lit(0), F.floor((F.col("_rows") - 1) / COPIES))))
    few = F.least(F.lit(COPIES), F.col("_rows") - F.col("_span") * COPIES).cast("int")
    copies = spans.withColumn("_few", few).repartition("_h", "_span").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_few"))))
    cut = copies.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / most).cast("int"))))
    start = (F.col("piece") * F.lit(most)).cast("long")
    shard = F.pmod(F.xxhash64("_h", "piece", "_span", "_copy"), F.lit(max(1, -(-total // shard_pieces))))
    pieces = cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(most), F.col("_n") - start).cast("int").alias("length"), shard.alias("shard"))

    def one(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, final = best_fit(x["length"].tolist(), capacities, attention)
        return x.assign(bin=bins, capacity=[final[b] for b in bins], offset=offsets)

    kind = docs.schema[id_col].dataType.simpleString()
    return pieces.groupBy("shard").applyInPandas(one, f"doc_id {kind}, piece int, start long, length int, shard long, bin int, capacity int, offset int")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
