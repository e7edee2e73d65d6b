"""Hierarchical Pitman-Yor language model: seating sampled by Gibbs over distributed counts, documents scored whole."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.arrow import bytes_of, mix64, words
from lakelens.llm.common import discard, remainder, stage, tidy, utf8
from lakelens.llm.nearcopies import pieces, unit

#: The end of a text, a token like the words; the start of a text, a context only.
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9D39247E33776D41)
#: Customers up to which seatings are drawn from a table; for larger parties, the numbers of tables that are taken one by one.
SMALL, FEW = 64, 8
#: Bytes of text that are cut into words at once, and tokens that are counted together: they set what a task holds.
PIECE, TOGETHER = 1 << 20, 1_000_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words and its end mark, and the number of tokens of each text."""
    h, counts = words(data, offsets)
    out = np.empty(len(h) + len(counts), np.uint64)
    ends = np.cumsum(counts + 1) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = h, END
    return out, counts + 1


def contexts_of(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The context of each token: the word before it, or START."""
    u = np.empty(len(w), np.uint64)
    u[1:] = w[:-1]
    u[np.cumsum(counts) - counts] = START
    return u


def pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(u * np.uint64(0x9E3779B97F4A7C15) ^ mix64(w))


def stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(n, k), n and k up to SMALL."""
    out = np.full((SMALL + 1, SMALL + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for n in range(1, SMALL + 1):
            k = np.arange(1, n + 1)
            out[n, 1 : n + 1] = np.logaddexp(out[n - 1, k - 1], np.log(np.maximum(n - 1 - d * k, 0)) + out[n - 1, k])
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers, by Stirling's series from 8 on."""
    x = np.asarray(x, float)
    low = np.maximum(8 - np.floor(x), 0).astype(int)
    shift = np.zeros(x.shape)
    for i in range(int(low.max(initial=0))):
        shift += np.where(i < low, np.log(np.where(i < low, x + i, 1.0)), 0.0)
    z = x + low
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def reach(d: float) -> tuple[float, int]:
    """Up to which t / c^d the written-out series keeps eight digits, and how many of its terms count there."""
    z = (8 / ((1 - d) * d ** (d / (1 - d)))) ** (1 - d)
    j = np.arange(1, 4001)
    size = j * math.log(z) + lgamma(1 + j * d) - lgamma(1.0 + j)
    return z, int(np.flatnonzero(size > size.max() - 45)[-1]) + 1


def log_series(c: np.ndarray, t: np.ndarray, d: float, terms: int) -> np.ndarray:
    """log S_d(c, t) - log (c - 1)! by the binomial series of (1 - (1 - x)^d)^t; c (n), t (n, m) not much above c^d.

    The coefficient of x^c in (1 - x)^jd is -sin(pi jd) gamma(1 + jd) gamma(c - jd) / (pi c!).
    """
    each, of = np.unique(c, return_inverse=True)
    first = lgamma(each - d)
    total, binomial = np.zeros(t.shape), np.ones(t.shape)
    for j in range(1, terms + 1):
        binomial = binomial * ((j - 1 - t) / j * (each**-d if j > 1 else np.ones(len(each)))[of][:, None])  # over c^d a term, which the gammas' ratio has too much
        some = each - j * d > 1e-3
        if not some.any():
            break
        size = np.where(some, lgamma(np.where(some, each - j * d, 1.0)) - first + math.lgamma(1 + j * d) + (j - 1) * d * np.log(each), -np.inf)
        total -= math.sin(math.pi * j * d) / math.pi * binomial * np.exp(np.minimum(size, 690))[of][:, None]
    return np.log(np.maximum(total, 1e-300)) - lgamma(t + 1) - t * math.log(d) + (first - lgamma(each))[of][:, None]


def log_saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for larger t below c, by the saddle point of the generating function."""
    lo, hi = np.full(t.shape, -700.0), np.full(t.shape, -1e-12)
    for _ in range(50):  # log (1 - x) at which x d/dx log F^t = c
        mid = (lo + hi) / 2
        big = np.log(t * d * -np.expm1(mid)) + (d - 1) * mid - np.log(-np.expm1(d * mid)) > np.log(c)
        lo, hi = np.where(big, mid, lo), np.where(big, hi, mid)
    y = (lo + hi) / 2
    x, f = -np.expm1(y), -np.expm1(d * y)
    g = x * d * np.exp((d - 1) * y) / f
    v = t * (g + g * (1 - d) * x * np.exp(-y) - g * g)  # the second derivative
    return t * np.log(f) - c * np.log1p(-np.exp(y)) - 0.5 * np.log(2 * math.pi * np.maximum(v, 1e-300)) + np.log(c) - lgamma(t + 1) - t * math.log(d)


def seat_many(c: np.ndarray, a: np.ndarray, d: float, u: np.ndarray, points: int = 192, nodes: int = 12) -> np.ndarray:
    """Draw t from S_d(c, t) a^t for c above SMALL: on all t, or on a grid of `points`, within nine deviations of the mode.

    log S is the series' as far as that reaches, then the saddle point's, met there; it hardly bends, so it is taken at
    `nodes` places of log t and interpolated. The first few t are taken one by one.
    """
    lo, hi = np.full(len(c), -700.0), np.full(len(c), -1e-12)
    for _ in range(50):  # the mode, through the saddle point that belongs to it
        mid = (lo + hi) / 2
        f = -np.expm1(d * mid)
        t = c * f / (-np.expm1(mid) * d) * np.exp((1 - d) * mid)
        up = np.log(f) + np.log(a / d) > np.log(t)
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    t = np.clip(t, 1.0, c)
    first, last = np.maximum(1.0, np.floor(t - 9 * np.sqrt(t) - 9)), np.minimum(c, np.ceil(t + 9 * np.sqrt(t) + 9))
    step = np.maximum(1.0, (last - first) / (points - 1))
    grid = first[:, None] + step[:, None] * np.arange(points)
    inside = grid <= last[:, None] + 1e-9
    grid = np.minimum(grid, last[:, None])
    z, terms = reach(d)
    turn = np.minimum(np.maximum(z * c**d, FEW), c - 1)[:, None]

    def log_s(t: np.ndarray) -> np.ndarray:
        """Less the half of log (c - t) that the saddle point's has, which bends."""
        out = np.empty(t.shape)
        near, far = np.flatnonzero((t <= turn).any(1)), np.flatnonzero((t > turn).any(1))
        if len(near):
            out[near] = log_series(c[near], np.minimum(t, turn)[near], d, terms)
        if len(far):
            of, edge = c[far][:, None], turn[far]
            met = log_series(c[far], edge, d, terms) - log_saddle(of, np.minimum(edge, of - 0.5), d)
            out[far] = np.where(t[far] <= edge, out[far], log_saddle(of, np.clip(t[far], edge, of - 0.5), d) + met)
        return out + 0.5 * np.log(np.maximum(c[:, None] - t, 0.5))

    # Barycentric interpolation at Chebyshev places of log t.
    bottom, top = np.log(np.maximum(first, FEW)), np.log(np.maximum(np.minimum(last, c - 0.5), FEW + 1.0))
    angle = (np.arange(nodes) + 0.5) * np.pi / nodes
    places = np.cos(angle)
    values = log_s(np.exp((bottom + top)[:, None] / 2 + (top - bottom)[:, None] / 2 * places))
    weight = np.sin(angle) * (-1.0) ** np.arange(nodes)
    q = (2 * np.log(np.maximum(grid, FEW)) - (bottom + top)[:, None]) / (top - bottom)[:, None]
    up_, down = np.zeros(grid.shape), np.zeros(grid.shape)
    for k in range(nodes):
        gap = q - places[k]
        gap = np.where(np.abs(gap) < 1e-12, 1e-12, gap)
        up_ += weight[k] / gap * values[:, k : k + 1]
        down += weight[k] / gap
    found = up_ / down
    few = np.flatnonzero(first <= FEW)
    if len(few):
        found[few] = np.where(grid[few] <= FEW, np.take_along_axis(log_s(np.broadcast_to(np.arange(1.0, FEW + 1), (len(c), FEW)))[few], np.minimum(grid[few].astype(int), FEW) - 1, 1), found[few])
    found = np.where(grid >= c[:, None], -lgamma(c)[:, None], found - 0.5 * np.log(np.maximum(c[:, None] - grid, 0.5)))  # everyone alone: S is 1
    w = np.where(inside, found + grid * np.log(a)[:, None], -np.inf)
    w = np.exp(w - w.max(1, keepdims=True)).cumsum(1)
    x = u * w[:, -1]
    k = (w < x[:, None]).sum(1)
    before = np.where(k > 0, np.take_along_axis(w, np.maximum(k - 1, 0)[:, None], 1)[:, 0], 0.0)
    part = (x - before) / np.maximum(np.take_along_axis(w, k[:, None], 1)[:, 0] - before, 1e-300)
    drawn = first + step * (k + np.where(step > 1, part - 0.5, 0.0))  # a grid's place stands for the stretch about it
    return np.clip(np.round(drawn), 1, c)


def seat(c: np.ndarray, a: np.ndarray, d: float, table: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Sample how many tables c customers of a dish sit at, given a: the strength of a new table times its dish's base.

    The number is drawn from its conditional, S_d(c, t) a^t, whatever c is: up to SMALL customers S comes from a table
    by the recursion, above from `seat_many`. u is uniform in (0, 1], one for each party.
    """
    t = np.ones(len(c))
    small = np.where(c <= SMALL, c, 0).astype(np.int64)
    order = np.argsort(small, kind="stable")
    edge = np.searchsorted(small[order], np.arange(2, SMALL + 2))
    for n, lo, hi in zip(range(2, SMALL + 1), edge, edge[1:], strict=False):
        for s in range(lo, hi, 200_000):
            at = order[s : min(hi, s + 200_000)]
            w = table[n, 1 : n + 1] + np.arange(1, n + 1) * np.log(a[at])[:, None]
            w = np.exp(w - w.max(1, keepdims=True)).cumsum(1)
            t[at] = 1 + (w < (u[at] * w[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(c > SMALL)
    for s in range(0, len(many), 4096):
        at = many[s : s + 4096]
        t[at] = seat_many(c[at], a[at], d, u[at])
    return np.minimum(t, c)


@dataclass
class Model:
    """Totals and discounts; one row a word and one a bigram, in staged tables; the commonest bigrams' predictions.

    words: (x, c, p, new, den): a word's count and root probability, and as a context its mass for the root's prediction
    and its denominator. own: (u, w, own), bucketed by both: the part of a bigram's prediction before division that its
    own seating gives. hot: words of the commonest words, a bounded number. head: keys, scores and base scores.
    """

    n: int
    v: int
    d: tuple[float, float]
    theta: tuple[float, float]
    unseen: float
    words: DataFrame
    own: DataFrame
    buckets: int
    hot: DataFrame
    head: tuple[np.ndarray, np.ndarray, np.ndarray]

    def release(self) -> None:
        """Drop the model's tables."""
        self.own.sparkSession.sql(f"DROP TABLE IF EXISTS {self.own.named}")
        discard(self.words.at)


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df, which is dealt by (u, w) to that many partitions, as a table that later joins find in place."""
    spark, name = df.sparkSession, f"lakelens_bigrams_{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").bucketBy(buckets, "u", "w").sortBy("u", "w").saveAsTable(name, format="parquet")
    out = spark.table(name)
    out.named = name
    return out


def least_count(df: DataFrame, most: int) -> int:
    """A count c that at most `most` rows of df reach; from a histogram in steps of a sixteenth of a power of two."""
    total, at = 0, 1 << 62
    step = F.floor(F.log2("c") * 16)
    for r in sorted(df.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r.c):
        total += r.n
        if total > most:
            break
        at = r.c
    return at


def count_pass(docs: DataFrame, of_pairs: bool) -> DataFrame:
    """(u, w, c): tokens counted within each batch, by word (u = 0) or by context and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            held: list[tuple[np.ndarray, np.ndarray]] = []  # tokens of some pieces, counted together
            for lo, hi in pieces(offsets, PIECE):
                w, each = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                held.append((w, contexts_of(w, each) if of_pairs else np.zeros(0, np.uint64)))
                if hi == batch.num_rows or sum(len(w) for w, _ in held) > TOGETHER:
                    w, u = (np.concatenate(x) for x in zip(*held, strict=True))
                    held.clear()
                    _, at, c = np.unique(pair(u, w) if of_pairs else w, return_index=True, return_counts=True)
                    w, u = w[at].view(np.int64), u[at].view(np.int64) if of_pairs else np.zeros(len(at), np.int64)
                    for s in range(0, len(w), 50_000):
                        e = s + 50_000
                        yield pa.RecordBatch.from_arrays([pa.array(u[s:e]), pa.array(w[s:e]), pa.array(c[s:e].astype(np.int64))], ["u", "w", "c"])

    return docs.select(utf8(F.col("text")).alias("bytes")).mapInArrow(run, "u long, w long, c long")


def looked_up(x: DataFrame, key: str, words: DataFrame, hot: DataFrame, columns: dict[str, str]) -> DataFrame:
    """x with the named columns of the words (x, ...) its key names, null where there is none.

    Hot words come by broadcast; their rows take a key of their own into the join, so that they do not meet in one task.
    """
    near = hot.select(F.col("x").alias(key), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_{c}") for c in columns])
    x = x.join(F.broadcast(near), key, "left")
    x = x.withColumn("_key", F.when(F.col("_hot"), F.xxhash64(F.lit("hot"), "u", "w")).otherwise(F.col(key)))
    far = words.select(F.col("x").alias("_key"), *[F.col(c).alias(f"__{c}") for c in columns])
    found = [F.when(F.col("_hot"), F.col(f"_{c}")).otherwise(F.col(f"__{c}")).alias(name) for c, name in columns.items()]
    kept = [c for c in x.columns if not c.startswith("_")]
    return x.join(far, "_key", "left").select(*kept, *found)


def sweep(heavy: DataFrame, words: DataFrame, hot: DataFrame, d: tuple[float, float], theta: tuple[float, float], v: int, root: tuple[float, float], seed: int, averaged: bool) -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """One round of Gibbs sampling: new seatings of the bigrams, then of the words in the root.

    heavy: (u, w, c, ts, near) with the tables summed so far and whether both words are hot, which need no shuffle;
    words: (x, c, cu, n1, s1, n, t, p, tw, ...); root: its customers and tables. A bigram that occurs once has one table
    whatever is sampled, so only the others are here; the words carry how many tables those have in them (n1) and in
    their context (s1).
    """
    z = np.uint64(0xD1B54A32D192ED03 * (seed + 1) % (1 << 64))

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = stirling(d[1])
        for batch in batches:
            u, w = (batch.column(c).to_numpy().view(np.uint64) for c in ("u", "w"))
            c, t, p, ts = (batch.column(c).to_numpy().astype(np.float64) for c in ("c", "t", "p", "ts"))
            now = seat(c, (theta[1] + d[1] * t) * p, d[1], table, unit(mix64(pair(u, w) ^ z)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "w", "c", "near")), pa.array(now), pa.array(ts + now if averaged else ts)], ["u", "w", "c", "near", "now", "ts"])

    columns = ["u", "w", "c", "near", "ts", "t", "p"]
    near = heavy.where("near").join(F.broadcast(hot.select(F.col("x").alias("u"), "t")), "u").join(F.broadcast(hot.select(F.col("x").alias("w"), "p")), "w")
    far = looked_up(looked_up(heavy.where("not near"), "u", words, hot, {"t": "t"}), "w", words, hot, {"p": "p"})
    x = near.select(columns).unionByName(far.select(columns))
    heavy = stage(x.mapInArrow(seated, "u long, w long, c long, near boolean, now double, ts double"), "lm-seats")
    base = (theta[0] + d[0] * root[1]) / (v + 1)

    def in_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = stirling(d[0])
        for batch in batches:
            x, n, tw = batch.column("x").to_numpy().view(np.uint64), batch.column("n").to_numpy(), batch.column("tw").to_numpy()
            now = seat(n, np.full(len(n), base), d[0], table, unit(mix64(x ^ z)))
            p = (n - d[0] * now + base) / (theta[0] + root[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "c", "cu", "n1", "s1", "n", "t")), pa.array(p), pa.array(now), pa.array(tw + now if averaged else tw)], ["x", "c", "cu", "n1", "s1", "n", "t", "p", "now", "tw"])

    words = tables_of(words.select("x", "c", "cu", "n1", "s1", "tw"), heavy, "now")
    words = stage(words.mapInArrow(in_root, "x long, c long, cu long, n1 double, s1 double, n double, t double, p double, now double, tw double"), "lm-words")
    return heavy, words, words.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("now"), F.lit(0.0))).first()


def tables_of(words: DataFrame, heavy: DataFrame, column: str) -> DataFrame:
    """words with n, the tables that serve the word in all contexts, and t, the tables of its own restaurant."""
    for key, once, name in (("w", "n1", "n"), ("u", "s1", "t")):
        more = heavy.groupBy(F.col(key).alias("x")).agg(F.sum(column).alias("_m"))
        words = words.join(more, "x", "left").withColumn(name, F.col(once) + F.coalesce("_m", F.lit(0.0))).drop("_m")
    return words


def train(docs: DataFrame, rounds: int = 3, head: int = 1 << 20, hot: int = 1 << 17, seed: int = 1) -> Model:
    """Fit the model to docs (text).

    Every bigram of the corpus is counted. Each word has a restaurant for what follows it, so has the start of a text;
    all share the root restaurant, whose base is uniform over the corpus's words and one unknown. The first of `rounds`
    Gibbs rounds is burnt, the seatings of the others are averaged. Predictions come from the averaged seatings and
    their own totals, so those of a context sum to 1. Broadcast are at most: the predictions of the `head` commonest
    bigrams and the rows of the `hot` commonest words. All others go by joins.
    """
    spark = docs.sparkSession
    uni = count_pass(docs, False).groupBy(F.col("w").alias("x")).agg(F.sum("c").alias("c"))
    uni = stage(uni, "lm-unigrams")
    end, start = (int(x.astype(np.int64)) for x in (END, START))
    n, v, texts = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("x") == end, F.col("c"))), F.lit(0))).first()
    # a bigram that occurs once adds to its word and context what their counts leave over: no later step reads it but own
    buckets = int(min(max(8, n // 4_000_000 + 1), 20_000))
    seen = bucketed(count_pass(docs, True).repartition(buckets, "u", "w").groupBy("u", "w").agg(F.sum("c").alias("c")), buckets)
    common = least_count(uni, hot)
    of_hot = lambda x: x.where(F.greatest("c", "cu") >= common)
    heavy = seen.where("c > 1").select("u", "w", "c", F.lit(0.0).alias("ts"))
    discount = lambda n1, n2: float(np.clip(n1 / (n1 + 2 * n2) if n1 + n2 else 0.5, 0.1, 0.95))
    words = uni.select("x", "c", F.when(F.col("x") == end, 0).otherwise(F.col("c")).alias("cu"))
    words = words.unionByName(spark.createDataFrame([(start, 0, texts)], "x long, c long, cu long"))
    for key, total, name, once in (("w", "c", "n", "n1"), ("u", "cu", "t", "s1")):
        k = heavy.groupBy(F.col(key).alias("x")).agg(F.sum("c").alias("_c"), F.count(F.lit(1)).alias("_k"))
        words = words.join(k, "x", "left").withColumn(once, (F.col(total) - F.coalesce("_c", F.lit(0))).cast("double"))
        words = words.withColumn(name, F.col(once) + F.coalesce("_k", F.lit(0))).drop("_c", "_k")
    words = stage(words.withColumn("tw", F.lit(0.0)), "lm-start")
    for key in ("u", "w"):
        heavy = heavy.join(F.broadcast(of_hot(words).select(F.col("x").alias(key), F.lit(True).alias(f"_{key}"))), key, "left")
    heavy = stage(heavy.select("u", "w", "c", "ts", (F.col("_u").isNotNull() & F.col("_w").isNotNull()).alias("near")), "lm-heavy")
    r = words.where("c > 0").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    b = seen.agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    d, theta, root = (discount(r.n1, r.n2), discount(b.n1, b.n2)), (1.0, 1.0), (float(r.n), float(v))
    first, words = words, words.withColumn("p", F.col("n") / F.lit(max(root[0], 1.0)))
    old = [first, heavy]
    for i in range(rounds):
        heavy, words, root = sweep(heavy, words, of_hot(words), d, theta, v, root, seed * 1000 + i, i > 0)
        discard(*old)
        old = [heavy, words]

    share = 1.0 / max(rounds - 1, 1)
    t = (F.col("ts") if rounds > 1 else F.col("now")) * share
    seats = heavy.select("u", "w", "c", "near", t.alias("t"))
    words = tables_of(words.select("x", "c", "cu", "n1", "s1", ((F.col("tw") if rounds > 1 else F.col("now")) * share).alias("tw")), seats, "t")
    words = stage(words, "lm-averaged")
    n_root, t_root = words.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("tw"), F.lit(0.0))).first()
    unseen = (theta[0] + d[0] * t_root) / (theta[0] + n_root) / (v + 1)
    den = F.col("cu") + theta[1]
    averaged = words
    words = words.select("x", "c", "cu", ((F.col("n") - d[0] * F.col("tw")) / (theta[0] + n_root) + unseen).alias("p"), ((theta[1] + d[1] * F.col("t")) / den).alias("new"), den.alias("den"))
    words.at = averaged
    t = seats.select("u", "w", "t").repartition(buckets, "u", "w")
    own = bucketed(seen.join(t, ["u", "w"], "left").select("u", "w", (F.col("c") - d[1] * F.coalesce("t", F.lit(1.0))).alias("own")), buckets)
    top = seats.where(F.col("c") >= least_count(seats, head))
    top = looked_up(looked_up(top, "u", words, of_hot(words), {"new": "new", "den": "den"}), "w", words, of_hot(words), {"p": "p", "c": "cw"})
    got = top.select("u", "w", F.log10((F.col("c") - d[1] * F.col("t")) / F.col("den") + F.col("new") * F.col("p")).alias("s"), F.log10((F.col("cw") + 0.1) / (n + 0.1 * (v + 1))).alias("b")).toArrow()
    keys = pair(*(got[c].to_numpy().view(np.uint64) for c in ("u", "w")))
    order = np.argsort(keys)
    spark.sql(f"DROP TABLE IF EXISTS {seen.named}")
    discard(uni, heavy, *old[1:])
    return Model(n, v, d, theta, unseen, words, own, buckets, of_hot(words), (keys[order], got["s"].to_numpy()[order], got["b"].to_numpy()[order]))


def score(docs: DataFrame, model: Model, parts: int = 6) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of docs (doc_id, text).

    Head bigrams are looked up in the broadcast arrays. Every other token goes by its bigram to the table of bigrams,
    and before that, unless both of its words are hot, by context and word to the table of words; what it finds is
    summed by document. That is done for `parts` shares of the documents in turn, so that no more than a share's tokens
    are on disk at a time.
    """
    hot = model.hot.orderBy("x").toArrow()
    words = [hot[c].to_numpy() for c in ("x", "c", "p", "new", "den")]
    words[0] = words[0].view(np.uint64)
    order = np.argsort(words[0])
    shared = docs.sparkSession.sparkContext.broadcast((model.head, [x[order] for x in words]))
    norm = model.n + 0.1 * (model.v + 1)
    x = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", utf8(F.col("text")).alias("bytes"))

    def places(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
        return at, (keys[at] == x) if len(keys) else np.zeros(len(x), bool)

    def each_piece(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Tokens, contexts and where they are in the head and among the hot words; near: not in the head, both words hot."""
        (keys, _, _), (hot_words, *_) = shared.value
        data, offsets = bytes_of(batch.column("bytes"))
        for lo, hi in pieces(offsets, PIECE):
            w, each = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            u = contexts_of(w, each)
            at, hit = places(keys, pair(u, w))
            (au, hu), (aw, hw) = places(hot_words, u), places(hot_words, w)
            yield lo, hi, w, each, u, at, hit, au, aw, ~hit & hu & hw

    def in_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, scores, bases), (_, counts, *_) = shared.value
        known = np.log10((counts + 0.1) / norm)
        for batch in batches:
            out = np.zeros((4, batch.num_rows))
            for lo, hi, _, each, _, at, hit, _, aw, near in each_piece(batch):
                text = np.repeat(np.arange(hi - lo), each)
                out[0, lo:hi] = each
                if hit.any():
                    out[1, lo:hi] = np.bincount(text[hit], minlength=hi - lo)
                    out[2, lo:hi] = np.bincount(text[hit], bases[at[hit]], hi - lo)
                    out[3, lo:hi] = np.bincount(text[hit], scores[at[hit]], hi - lo)
                if near.any():
                    out[1, lo:hi] += np.bincount(text[near], minlength=hi - lo)
                    out[2, lo:hi] += np.bincount(text[near], known[aw[near]], hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), *(pa.array(out[i].astype(np.int64)) for i in (0, 1)), *(pa.array(out[i]) for i in (2, 3))], ["key", "doc_id", "n", "known", "base", "score"])

    def in_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, (_, _, p, new, den) = shared.value
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for lo, hi, w, each, u, _, _, au, aw, near in each_piece(batch):
                k, a, b = np.repeat(keys[lo:hi], each)[near], 1 / den[au[near]], new[au[near]] * p[aw[near]]
                w, u = w[near].view(np.int64), u[near].view(np.int64)
                for s in range(0, len(k), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 50_000]) for x in (k, u, w, a, b)], ["key", "u", "w", "a", "b"])

    def in_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for lo, hi, w, each, u, _, hit, _, _, near in each_piece(batch):
                far = ~hit & ~near
                k, w, u = np.repeat(keys[lo:hi], each)[far], w[far].view(np.int64), u[far].view(np.int64)
                for s in range(0, len(k), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 50_000]) for x in (k, u, w)], ["key", "u", "w"])

    tails = None
    for i in range(parts):
        some = x.where(F.pmod("key", F.lit(parts)) == i).select("key", "bytes")
        far = some.mapInArrow(in_far, "key long, u long, w long")
        far = looked_up(looked_up(far, "u", model.words, model.hot, {"new": "new", "den": "den"}), "w", model.words, model.hot, {"p": "p", "c": "c"})
        b = F.coalesce("new", F.lit(1.0)) * F.coalesce("p", F.lit(model.unseen))
        far = far.select("key", "u", "w", F.coalesce(1 / F.col("den"), F.lit(0.0)).alias("a"), b.alias("b"), F.coalesce("c", F.lit(0)).alias("c"))
        near = some.mapInArrow(in_near, "key long, u long, w long, a double, b double").withColumn("c", F.lit(None).cast("long"))
        tail = near.unionByName(far).repartition(model.buckets, "u", "w").join(model.own, ["u", "w"], "left")
        tail = tail.select("key", "c", F.log10(F.coalesce("own", F.lit(0.0)) * F.col("a") + F.col("b")).alias("s"))
        # near tokens have their count, and their part of the base score, from the broadcast words
        tail = tail.groupBy("key").agg(F.count_if(F.col("c") > 0).alias("k2"), F.sum(F.log10((F.col("c") + 0.1) / F.lit(norm))).alias("b2"), F.sum("s").alias("s2"))
        tail = stage(tail, "lm-tail")
        tails = tail if tails is None else tails.unionByName(tail)
    kind = docs.schema["doc_id"].dataType.simpleString()
    main = x.mapInArrow(in_head, f"key long, doc_id {kind}, n long, known long, base double, score double")
    main = main.groupBy("key", "doc_id", "n", "known", "base", "score").agg(F.count(F.lit(1)).alias("rows"))
    x = main.join(tails, "key", "left").withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b) / F.col("rows"), F.lit(0.0))
    return x.select("doc_id", F.col("n").alias("n_tokens"), plus("known", "k2").cast("long").alias("n_known"), plus("base", "b2").alias("base_score"), plus("score", "s2").alias("score"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out documents score by a model that never saw them; null text is empty and has its end mark only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder("doc_id", 10) == 0
    model = train(docs.where(~held_out))
    out = score(docs, model)
    model.release()
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
