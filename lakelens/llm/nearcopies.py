"""Near-duplicate documents by DartMinHash over weighted word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.arrow import bytes_of, mix64, words
from lakelens.llm.common import discard, link_buckets, stage, utf8

#: Element hashes are kept to 44 bits, so that a text's number (20 bits) and an element sort as one integer.
BITS = np.uint64(44)
LOW = np.uint64((1 << 44) - 1)


def elements(hashes: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text << 44 | hash), sorted, and how often each occurs.

    A shingle is `size` words in a row; a text of fewer words is one shingle. Texts without words have none.
    """
    n = len(hashes)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    left = ends[text] - np.arange(n)  # words from here to the end of the text
    wide = np.concatenate([hashes, np.zeros(size, np.uint64)])
    keys, inside = np.zeros(n, np.uint64), np.arange(n)
    for j in range(size):
        part = np.where(left > j, wide[inside + j], np.uint64(0))
        keys = (keys + part) * np.uint64(0xD6E8FEB86659FD93) ^ (keys >> np.uint64(29))
    use = (left >= size) | (left == counts[text])
    return np.unique((text[use].astype(np.uint64) << BITS) | (mix64(keys[use]) & LOW), return_counts=True)


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_signatures(keys: np.ndarray, weights: np.ndarray, texts: int, k: int) -> np.ndarray:
    """k coordinates of 32 bits for each text's weighted set; a row of zeros for an empty set.

    Every element's weight axis is cut into layers [0, 1), [1, 2), [2, 4), ... In each layer darts fall along the
    rank axis as a Poisson process whose gaps, heights and coordinates are hashes of (element, layer, number),
    so the same darts fall in every set. A dart counts where it falls below the element's weight, and each
    coordinate keeps the dart of least rank. Only ranks up to t are thrown, t being set so that about
    k ln k + 2k darts count in all; texts left with an empty coordinate are thrown again up to 2 t.
    """
    text = (keys >> BITS).astype(np.int64)
    total = np.bincount(text, weights, texts)
    best = np.full(texts * k, np.iinfo(np.uint64).max, np.uint64)
    reach = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        pick = todo[text]
        e, d, w = mix64((keys[pick] & LOW) + np.uint64(1)), text[pick], weights[pick]
        layer, low, span = 0, 0.0, 1.0
        while len(e):
            h0, at, rank, j = mix64(e + np.uint64(0xA24BAED4963EE407 * (layer + 1) % (1 << 64))), np.arange(len(e)), np.zeros(len(e)), 0
            while len(at):
                h = mix64(h0[at] + np.uint64(0x9FB21C651E98DF25 * (j + 1) % (1 << 64)))
                rank = rank - np.log(unit(h)) / span
                on = rank <= reach[d[at]]
                at, rank, h = at[on], rank[on], mix64(h[on])
                hit = low + span * unit(mix64(h ^ np.uint64(0x5851F42D4C957F2D))) <= w[at]
                bits = rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64)
                dart = h[hit]
                np.minimum.at(best, d[at[hit]] * k + (dart >> np.uint64(32)).astype(np.int64) % k, bits << np.uint64(32) | (dart & np.uint64(0xFFFFFFFF)))
                j += 1
            low, span, layer = low + span, low + span, layer + 1
            more = w > low
            e, d, w = e[more], d[more], w[more]
        empty = (best.reshape(texts, k) == np.iinfo(np.uint64).max).any(1)
        todo &= empty
        reach[todo] *= 2
    sig = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(texts, k)
    sig[total == 0] = 0
    return sig


def pieces(offsets: np.ndarray, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes, a longer text alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size))), n)
        yield lo, hi
        lo = hi


def signatures(docs: DataFrame, band_count: int, band_rows: int, shingle_words: int) -> DataFrame:
    """(id, digest, bytes) to (id, digest, bands array<long>): the banded DartMinHash signature, null without words."""
    k = band_count * band_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("bytes"))
            n = batch.num_rows
            keys, some = np.zeros((n, band_count), np.int64), np.zeros(n, bool)
            for lo, hi in pieces(offsets):
                h, counts = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                e, w = elements(h, counts, shingle_words)
                sig = dart_signatures(e, w.astype(np.float64), hi - lo, k).astype(np.uint64).reshape(hi - lo, band_count, band_rows)
                key = np.broadcast_to(np.arange(1, band_count + 1, dtype=np.uint64), (hi - lo, band_count)).copy()
                for r in range(band_rows):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                keys[lo:hi], some[lo:hi] = key.view(np.int64), counts > 0
            flat = pa.array(keys.ravel())
            at = pa.array(np.arange(n + 1, dtype=np.int32) * band_count, mask=np.append(~some, False))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.ListArray.from_arrays(at, flat)], ["id", "digest", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, digest string, bands array<long>")


def shingle_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(id, bytes) to (id, payload array<long>): each text's shingles as distinct hashes, the k-th copy of a shingle being one of its own.

    The Jaccard similarity of these sets is the weighted one of the shingle counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("bytes"))
            for lo, hi in pieces(offsets):
                e, w = elements(*words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), shingle_words)
                copy = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                text = np.repeat((e >> BITS).astype(np.int64), w)
                h = mix64(np.repeat(e & LOW, w) ^ (copy.astype(np.uint64) << BITS))
                at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["id", "payload"])

    return texts.mapInArrow(run, "id long, payload array<long>")


def near_classes(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, band_count: int = 30, band_rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, class_id, kept) of every row with an id: near_copies, the text's md5 beside the id."""
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    x = t.select("id", F.md5(utf8(F.col("text"))).alias("digest"), utf8(F.col("text")).alias("bytes"))
    sig = stage(signatures(x, band_count, band_rows, shingle_words), "near-signatures")
    texts = sig.where("bands is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    texts = stage(texts.withColumn("node", F.monotonically_increasing_id()), "near-texts")

    def load(nodes: DataFrame) -> DataFrame:
        some = texts.select("node", "rep", "digest").join(nodes.withColumnRenamed("id", "node"), "node", "left_semi")
        x = t.join(some, (F.col("id") == F.col("rep")) & (F.md5(utf8(F.col("text"))) == F.col("digest"))).select(F.col("node").alias("id"), utf8(F.col("text")).alias("bytes"))
        return shingle_sets(x.dropDuplicates(["id"]), shingle_words)

    comp = link_buckets(texts.select(F.explode(F.array_distinct("bands")).alias("bucket"), F.col("node").alias("id")), load, F.col, similarity, "near")
    linked = texts.select("digest", "rep", F.col("node").alias("id")).join(comp, "id")
    first = linked.groupBy("component").agg(F.min(F.struct("rep", "digest")).alias("first"))
    classes = linked.join(first, "component").select("digest", "first")
    alone = texts.select("digest", "rep").join(classes, "digest", "left").select("digest", F.coalesce("first", F.struct("rep", "digest")).alias("first"))
    out = sig.select("id", "digest").join(stage(alone, "near-classes"), "digest", "left")
    out = out.select(F.col("id").alias("doc_id"), "digest", F.coalesce("first.rep", "id").alias("class_id"), F.coalesce((F.col("first.rep") == F.col("id")) & (F.col("first.digest") == F.col("digest")), F.lit(True)).alias("kept"))
    discard(texts, comp)
    return out


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, kept) of every row: class_id is the least doc_id of its class, kept whether it is its own.

    Words are runs without white space, A-Z lower-cased; a document is the multiset of its runs of shingle_words
    words. Two documents are linked if that weighted Jaccard similarity is at least `similarity`; classes are the
    components of the links. Equal texts are one entry before anything is compared. Candidates share a band of
    their DartMinHash signatures (a pair at 0.8 has one with probability 0.9999) and are verified on whole texts.

    Documents without a word, null text included, are their own class. A null doc_id has a null class and is kept.
    Rows that repeat each have their row; rows of one id and different texts are told apart, and of those in one class
    one is kept. An empty table gives an empty result; other columns are ignored.
    """
    some = near_classes(docs, similarity, shingle_words, id_col=id_col, text_col=text_col, **options).select("doc_id", "class_id", "kept")
    none = docs.where(F.col(id_col).isNull()).select(*[F.lit(None).cast("long").alias(c) for c in ("doc_id", "class_id")], F.lit(True).alias("kept"))
    return some.unionByName(none)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that near_copies does not keep; of rows that share an id only those with the copy's text go."""
    gone = near_classes(docs, id_col=id_col, text_col=text_col, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    return docs.join(gone, (F.col(id_col).cast("long") == F.col("_id")) & (F.md5(utf8(F.col(text_col))) == F.col("_digest")), "left_anti")


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
