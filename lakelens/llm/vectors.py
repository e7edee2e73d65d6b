"""Near-duplicate vectors: iterative quantisation to binary codes, multi-index Hamming tables, rerank by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import bounded_sample, components, stage


def itq(sample: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """A projection (dims x bits) whose signs are the code: principal axes, then a rotation learned by turns.

    Each turn takes the codes B = sign(V R) nearest to the rotated data and the rotation R nearest to the codes
    (from the singular vectors of B'V), which lowers the quantisation loss and evens out the bits.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    bits = min(bits, dims)
    _, axes = np.linalg.eigh(sample.T @ sample + 1e-9 * np.eye(dims))
    axes = axes[:, ::-1][:, :bits]
    v = sample @ axes
    r, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return axes @ r


def plan_tables(group: int, threshold: float, bits: int, miss: float = 0.02) -> tuple[int, int]:
    """Bits of a table's key and number of rotations for groups of up to `group` vectors.

    Keys have about log2(group) bits, so that a bucket holds a few unlike vectors. A pair at the threshold's angle
    differs in a bit with probability angle / pi; enough tables are taken that it shares a key but for `miss`.
    """
    key = min(max(6, math.ceil(math.log2(max(group, 2)))), 30, bits)
    one = (1 - math.acos(threshold) / math.pi) ** key
    return key, max(1, math.ceil(math.log(miss) / math.log(1 - one) / (bits // key)))


def vector_links(vectors: DataFrame, threshold: float = 0.93, bits: int = 64, fit_rows: int = 20000, seed: int = 5) -> DataFrame:
    """Links (a, b), a < b, between distinct vectors of a label whose cosine in double precision reaches threshold.

    vectors: (id, label, v array<double>), valid, ids unique. The rotations are fitted on the fit_rows vectors first
    by hash of id (all, if fewer); every vector is coded and put into every table. A candidate pair is taken from
    the first table it shares, passes if its codes' Hamming distance is plausible at the threshold, and is reranked
    with the original vectors, so no link lies below the threshold.
    """
    empty = vectors.sparkSession.createDataFrame([], "a long, b long")
    sample = [r.v for r in bounded_sample(vectors.select("v", "id"), "id", fit_rows).collect()]
    if not sample:
        return empty
    dims = max(len(v) for v in sample)
    x = np.zeros((len(sample), dims))
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits = min(bits, dims)
    group = vectors.groupBy("label").count().agg(F.max("count")).first()[0]
    key, turns = plan_tables(group, threshold, bits)
    each = bits // key
    proj = np.concatenate([itq(x, bits, seed + i) for i in range(turns)], axis=1)
    flips = turns * bits * math.acos(threshold) / math.pi
    most = flips + 4 * math.sqrt(flips)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = np.zeros((len(f), dims))
            for i, v in enumerate(f["v"]):
                m[i, : min(len(v), dims)] = v[:dims]
            b = (m @ proj >= 0).reshape(len(f), turns, bits)
            keys = (b[:, :, : each * key].reshape(len(f), turns * each, key) @ (1 << np.arange(key, dtype=np.int64))).astype(np.int64)
            pad = np.zeros((len(f), turns, 64), bool)
            pad[:, :, :bits] = b
            codes = np.packbits(pad, axis=2).reshape(len(f), turns, 8).copy().view(np.int64)[:, :, 0]
            yield pd.DataFrame({"id": f["id"], "label": f["label"], "keys": list(keys), "codes": list(codes)})

    kind = vectors.schema["label"].dataType.simpleString()
    coded = stage(vectors.select("id", "label", "v").mapInPandas(encode, f"id long, label {kind}, keys array<long>, codes array<long>"), "vec-codes")
    rows = coded.select("id", "label", "keys", "codes", F.posexplode("keys").alias("t", "key"))
    left = rows.select("label", "t", "key", F.col("id").alias("a"), F.col("keys").alias("ka"), F.col("codes").alias("ca"))
    right = rows.select("label", "t", "key", F.col("id").alias("b"), F.col("keys").alias("kb"), F.col("codes").alias("cb"))
    apart = F.aggregate(F.zip_with("ca", "cb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    first = F.array_position(F.zip_with("ka", "kb", lambda p, q: p == q), True) == F.col("t") + 1
    pairs = left.join(right, ["label", "t", "key"]).where((F.col("a") < F.col("b")) & (apart <= most) & first).select("a", "b")
    v = vectors.select("id", "v")
    joined = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")

    def rerank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["va"].map(len) == f["vb"].map(len)]
            cos = [float(p @ q / math.sqrt(float(p @ p) * float(q @ q))) for p, q in zip(f["va"], f["vb"], strict=True)]
            yield f.loc[np.array(cos, float) >= threshold, ["a", "b"]]

    return joined.mapInPandas(rerank, "a long, b long")


def near_vectors(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are compared only within a label that is not null. Those that are null, empty, zero or hold null or
    non-finite components link with nothing, as do rows whose id is null (their component is null and they are
    kept). Equal vectors of a label are one entry with a count before anything is compared, so a vector that fills
    a third of the table costs one comparison. Vectors of unequal length never link. An empty table gives an empty
    result; other columns are ignored.
    """
    t = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(F.col(vec_col), lambda e: e.cast("double")).alias("v"))
    t = t.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    fine = F.col("norm").isNotNull() & ~F.isnan("norm") & (F.col("norm") > 0) & (F.col("norm") < F.lit(float("inf"))) & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = stage(t.where(fine).select("id", "label", "v").distinct(), "vec-good")
    reps = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    members = stage(good.join(reps, ["label", "v"]).select("id", "rep", "n", "label", "v"), "vec-members")
    unique = members.where("id = rep")
    links = stage(vector_links(unique.select("id", "label", "v"), threshold, **options), "vec-links")
    comp = components(links, tag="vec")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(unique.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    classes = members.select("id", "rep", "n").join(counts, "rep", "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    classes = classes.groupBy("id").agg(F.max(F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.min(F.coalesce("component", "rep")).alias("component"))
    out = t.select("id").join(classes, "id", "left")
    c = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(c == F.col("id"), F.lit(True)).alias("kept"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
