"""Repeated passages: suffix arrays by two-stage sorting over the passages that documents share, bytes removed."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.arrow import P, P_INV, bytes_of, mix64, powers
from lakelens.llm.common import discard, stage, tidy, utf8
from lakelens.llm.nearcopies import pieces

#: Bytes of an anchor; a string of `size` bytes holds size - GRAM + 1 of them. Places that are worked on at once.
GRAM, BLOCK = 20, 1 << 16


def anchors(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Each text's strings of `size` bytes, grouped by their anchor, the string's leftmost gram of least hash (by its low bits).

    Equal strings have equal anchors at equal places. Returns for each run of strings with one anchor: its text, the
    place of the first string in data, the number of strings (at most size - GRAM + 1), the anchor's hash.
    """
    n, w = len(data), size - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.view(np.uint64)
    h, place = np.empty(n - GRAM + 1, np.uint64), np.empty(n - size + 1, np.int64)
    for lo in range(0, n - GRAM + 1, BLOCK):
        x = data[lo : lo + BLOCK + GRAM - 1]
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers(P, len(x)), out=total[1:])
        h[lo : lo + BLOCK] = mix64((total[GRAM:] - total[:-GRAM]) * powers(P_INV, len(x) - GRAM + 1))
    for lo in range(0, n - size + 1, BLOCK):
        place[lo : lo + BLOCK] = lo + leftmost_least(h[lo : lo + BLOCK + w - 1], w)
    at = np.arange(n - size + 1)
    length = np.diff(offsets)
    text = np.repeat(np.arange(len(length)), length)[: n - size + 1]
    ok = at + size <= offsets[text + 1]
    at, place, text = at[ok], place[ok], text[ok]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], at[first], np.diff(np.append(first, len(at))), h[place[first]]


def cut_anchors(data: np.ndarray, offsets: np.ndarray, size: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() of a batch in parts of about `most` bytes: (text, place in data, number, hash); a longer text is cut with an overlap of size - 1."""
    long = np.flatnonzero(np.diff(offsets) > most)
    edges = np.unique(np.concatenate([[0], long, long + 1, [len(offsets) - 1]]))  # long texts stand alone
    for lo, hi in [(a + x, a + y) for a, b in zip(edges, edges[1:], strict=False) for x, y in pieces(offsets[a : b + 1], most)]:
        if offsets[hi] - offsets[lo] <= 2 * most and lo not in long:
            text, start, count, fp = anchors(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
            yield lo + text, offsets[lo] + start, count, fp
            continue
        for at in range(offsets[lo], offsets[hi], most):
            part = data[at : min(at + most + size - 1, offsets[hi])]
            text, start, count, fp = anchors(part, np.array([0, len(part)]), size)
            yield lo + text, at + start, count, fp


def leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of h[i : i + w] for every i, the leftmost of equals: running minima over spans that double.

    The high bits of h, as many for every block, give way to the places and do not count.
    """
    bits = np.uint64((BLOCK + w).bit_length())
    x, span = h << bits | np.arange(len(h), dtype=np.uint64), 1
    while span < w:
        step = min(span, w - span)
        x, span = np.minimum(x[: len(x) - step], x[step:]), span + step
    return (x & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def packed(data: np.ndarray, size: int) -> list[np.ndarray]:
    """For every place the bytes from there on as big-endian integers of 8, enough of them for `size` bytes."""
    wide = np.concatenate([data, np.zeros(size + 16, np.uint8)]).astype(np.uint64)
    one = np.zeros(len(data) + size + 8, np.uint64)
    for j in range(8):
        one = (one << np.uint64(8)) | wide[j : j + len(one)]
    return [one[8 * j : 8 * j + len(data)] for j in range(-(-size // 8))]


def two_stage_suffixes(data: np.ndarray, size: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of data to a depth of at least `size` bytes, and adjacent common prefixes up to `size`.

    Suffixes smaller than their successor are sorted directly. The others are induced: taking first bytes in rising
    order, a larger one's place among its byte's follows its successor's, which stands in an earlier bucket or,
    in a run of one byte, just before; in each bucket they precede those sorted directly. wanted limits the array to
    some suffixes and those from which they are induced.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = packed(data, size)
    # a suffix is smaller than its successor if the byte that ends its run of equal bytes is larger; the end is smallest
    change = np.flatnonzero(np.append(data[1:] != data[:-1], True))
    end = change[np.searchsorted(change, np.arange(n))]
    smaller = np.append(data, 0)[end + 1] > data
    smaller[end == n - 1] = False
    need = np.ones(n, bool)
    if wanted is not None:
        direct_at = np.flatnonzero(smaller)
        last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        stop = np.append(direct_at, n - 1)[np.searchsorted(direct_at, last)]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, last, 1)
        np.subtract.at(edge, stop + 1, 1)
        need = wanted | (np.cumsum(edge[:-1]) > 0)
    b = np.flatnonzero(smaller & need)
    b = b[np.lexsort([k[b] for k in reversed(keys)])]
    rank = np.zeros(n + 1, np.int64)
    size_of = np.bincount(data[need], minlength=256)
    begin = np.cumsum(size_of) - size_of
    direct = np.bincount(data[b], minlength=256)
    first_b = np.cumsum(direct) - direct
    rank[b] = begin[data[b]] + (size_of - direct)[data[b]] + np.arange(len(b)) - first_b[data[b]]
    rank[n] = -1
    a = np.flatnonzero(~smaller & need)
    run = end[a] - a
    order = np.lexsort([run, data[a]])
    a, run = a[order], run[order]
    cuts = np.searchsorted(data[a], np.arange(257))
    for c in np.flatnonzero(np.diff(cuts)):
        lo, hi, at = cuts[c], cuts[c + 1], begin[c]
        level = np.searchsorted(run[lo:hi], np.arange(run[hi - 1] + 2)) + lo
        for s, e in zip(level, level[1:], strict=False):  # runs of one byte, shortest rest first
            x = a[s:e]
            x = x[np.argsort(rank[x + 1], kind="stable")]
            rank[x] = at + np.arange(len(x))
            at += len(x)
    places = np.flatnonzero(need)
    n = len(places)
    sa = np.empty(n, np.int64)
    sa[rank[places]] = places
    common, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    open_[0] = False
    for k in keys:
        x = k[sa[1:]] ^ k[sa[:-1]]
        bits = np.full(n - 1, 64, np.int64)
        some = x != 0
        top = x[some]
        lead = np.zeros(len(top), np.int64)
        for s in (32, 16, 8):
            small = top >> np.uint64(64 - s) == 0
            lead[small] += s
            top = np.where(small, top << np.uint64(s), top)
        bits[some] = lead // 8 * 8
        common[1:] += np.where(open_[1:], bits // 8, 0)
        open_[1:] &= ~some
    return sa, np.minimum(common, size)


def least_owner(snippets: list[bytes], counts: np.ndarray, owners: np.ndarray, size: int) -> list[np.ndarray]:
    """For each snippet's first counts[i] strings of `size` bytes the least owner among all snippets with that string."""
    data = np.frombuffer(b"".join(snippets), np.uint8)
    at = np.cumsum([0, *map(len, snippets)])[:-1]
    start = np.repeat(at - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    number = np.full(len(data), -1, np.int64)
    number[start] = np.arange(len(start))
    owner = np.repeat(owners, counts)
    sa, common = two_stage_suffixes(data, size, number >= 0)
    # strings that start in order of suffixes; a new class wherever a common prefix in between is short
    klass = np.cumsum(common < size)
    own = number[sa] >= 0
    who, klass = number[sa][own], klass[own]
    first = np.flatnonzero(np.diff(klass, prepend=-1))
    least = np.minimum.reduceat(owner[who], first) if len(first) else owner[:0]
    out = np.empty(len(start), np.int64)
    out[who] = np.repeat(least, np.diff(np.append(first, len(who))))
    return np.split(out, np.cumsum(counts)[:-1])


def repeated_bytes(docs: DataFrame, size: int = 50, group_rows: int = 20000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a string of `size` bytes that also starts in a document of smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. Texts are UTF-8 bytes, null empty. A text
    equal to one of smaller id goes whole without further work (if it has `size` bytes). The others are written once,
    bucketed by id. Strings are grouped by their anchor; only anchors that occur in several documents are carried
    on, as snippets of the bytes around them. Equal snippets are combined to their least id before they are dealt
    by anchor into groups of about group_rows, whose suffixes are sorted; each string's least id comes back to its
    places. Rows without an id keep everything; repeated rows have equal results; an empty table gives none.
    """
    spark = docs.sparkSession
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("bytes"))
    ids = stage(t.select("doc_id", F.md5("bytes").alias("digest"), F.octet_length("bytes").cast("long").alias("n_bytes")), "rep-ids")
    first = ids.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    copies = stage(ids.join(first, "digest").where((F.col("doc_id") != F.col("rep")) & (F.col("n_bytes") >= size)).select("doc_id", "digest", "n_bytes"), "rep-copies")

    # one shuffle of the texts, by id; both later joins find them in place
    name = f"lakelens_repeats_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gone = copies.groupBy("doc_id").agg(F.collect_set("digest").alias("gone"))
    own = t.repartition(buckets, "doc_id").join(gone, "doc_id", "left").withColumn("digest", F.md5("bytes"))
    own = own.where(~F.coalesce(F.array_contains("gone", F.col("digest")), F.lit(False))).select("doc_id", F.xxhash64("digest").alias("h"), "bytes")
    with tidy(spark):
        own.write.option("compression", "zstd").bucketBy(buckets, "doc_id").saveAsTable(name, format="parquet")
    texts = spark.table(name)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data, offsets), doc = bytes_of(batch.column("bytes")), batch.column("doc_id").to_numpy()
            for text, _, _, fp in cut_anchors(data, offsets, size):
                for s in range(0, len(fp), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[s : s + 50_000].view(np.int64)), pa.array(doc[text[s : s + 50_000]])], ["fp", "doc_id"])

    seen = texts.where("doc_id is not null").select("doc_id", "bytes").mapInArrow(prints, "fp long, doc_id long").repartition("fp")
    shared = seen.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("fp")
    wanted = stage(seen.join(shared, "fp").groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "rep-anchors")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = lambda fp, row: mix64(fp ^ (row.astype(np.uint64) * P))
        for batch in batches:
            (data, offsets), doc, h = bytes_of(batch.column("bytes")), batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
            lists = batch.column("fps")
            known = salt(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())))
            for text, start, count, fp in cut_anchors(data, offsets, size):
                on = np.isin(salt(fp, text), known)
                text, start, count, fp = text[on], start[on], count[on], fp[on]
                for s in range(0, len(fp), 20_000):
                    x = slice(s, s + 20_000)
                    snippets = [data[p : p + c + size - 1].tobytes() for p, c in zip(start[x].tolist(), count[x].tolist(), strict=True)]
                    own = (start[x] - offsets[text[x]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)), pa.array(doc[text[x]]), pa.array(h[text[x]]), pa.array(own), pa.array(count[x].astype(np.int32)), pa.array(snippets, pa.binary())], ["fp", "doc_id", "h", "start", "count", "snippet"])

    cuts = texts.join(wanted, "doc_id").select("doc_id", "h", "bytes", "fps").mapInArrow(cut, "fp long, doc_id long, h long, start int, count int, snippet binary")
    cut_table = stage(cuts, "rep-cuts")
    discard(wanted)
    cuts = cut_table.withColumn("sid", F.xxhash64("snippet"))  # made when read: hashes do not compress
    unique = stage(cuts.groupBy("fp", "sid").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.first("count").alias("count"), F.first("snippet").alias("snippet")), "rep-snippets")
    at = stage(cuts.select("fp", "sid", "doc_id", "h", "start"), "rep-places")
    discard(cut_table)
    groups = max(1, -(-unique.count() // group_rows))

    def sort(x: pd.DataFrame) -> pd.DataFrame:
        least = least_owner(x["snippet"].tolist(), x["count"].to_numpy(np.int64), x["owner"].to_numpy(np.int64), size)
        useful = [bool((m < last).any()) for m, last in zip(least, x["last"], strict=True)]
        return pd.DataFrame({"fp": x["fp"], "sid": x["sid"], "least": least})[useful]

    owners = unique.groupBy(F.pmod(F.xxhash64("fp"), F.lit(groups)).alias("g")).applyInPandas(sort, "fp long, sid long, least array<long>")
    owners = stage(owners, "rep-owners")  # so that the shuffled snippets go before the places are shuffled
    discard(unique)
    hit = at.join(owners, ["fp", "sid"])
    places = F.filter(F.transform("least", lambda m, i: F.when(m < F.col("doc_id"), F.col("start") + i)), lambda p: p.isNotNull())
    # a snippet's strings to remove, as runs: a place whose predecessor is not one begins a run
    runs = hit.withColumn("p", places).where(F.size("p") > 0)
    runs = runs.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("p")).alias("starts"))
    runs = runs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "starts"))).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data, offsets), starts, rows = bytes_of(batch.column("bytes")), batch.column("starts"), []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(raw) + 1, np.int32)
                if starts[i].is_valid:
                    s = np.unique(starts[i].values.to_numpy())
                    edge[s] += 1
                    np.subtract.at(edge, s + size, 1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                rows.append((len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    runs = stage(runs, "rep-runs")
    discard(owners, at)
    kept = texts.join(runs, "doc_id", "left").select("doc_id", "bytes", F.try_element_at("runs", F.col("h")).alias("starts"))
    kept = stage(kept.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "rep-kept")
    discard(runs)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return kept.unionByName(copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256")))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
