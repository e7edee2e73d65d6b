"""Language identification by a byte convolutional network, trained and applied with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.arrow import LOWER, bytes_of
from lakelens.llm.common import bounded_sample, remainder, utf8

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows of WINDOW bytes, the last of each padded with 0: bytes, text, bytes used."""
    size = np.diff(offsets)
    each = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), each)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * WINDOW
    used = np.minimum(size[text] - start, WINDOW)
    out = np.zeros((len(text), WINDOW), np.uint8)
    inside = np.arange(WINDOW) < used[:, None]
    out[inside] = LOWER[data]
    return out, text, used


class ByteNet:
    """Filters of several widths over bytes, max pooling over the window, a linear layer and softmax.

    A filter of width k is a table a byte for each of its k places (a one-hot input's convolution).
    """

    def __init__(self, langs: list[str], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {f"t{k}": rng.normal(0, 0.3, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.p |= {"b": np.zeros(len(WIDTHS) * FILTERS, np.float32), "u": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32), "c": np.zeros(len(langs), np.float32)}

    def convolve(self, x: np.ndarray) -> list[np.ndarray]:
        return [sum(self.p[f"t{k}"][j][x[:, j : x.shape[1] - k + 1 + j]] for j in range(k)) for k in WIDTHS]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteNet:
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        weight = len(y) / (len(self.langs) * np.maximum(np.bincount(y, minlength=len(self.langs)), 1))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                xb, yb, rows = x[at], y[at], np.arange(len(at))
                maps = self.convolve(xb)
                peak = [r.argmax(1) for r in maps]
                pooled = np.concatenate([np.take_along_axis(r, a[:, None], 1)[:, 0] for r, a in zip(maps, peak, strict=True)], 1) + self.p["b"]
                h = np.maximum(pooled, 0)
                z = h @ self.p["u"] + self.p["c"]
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[rows, yb] -= 1
                q *= (np.minimum(weight[yb], 5.0) / len(at))[:, None]
                gh = (q @ self.p["u"].T) * (pooled > 0)
                g = {"u": h.T @ q, "c": q.sum(0), "b": gh.sum(0)}
                for i, k in enumerate(WIDTHS):
                    gk, part = np.zeros_like(self.p[f"t{k}"]), gh[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(k):
                        np.add.at(gk[j], (xb[rows[:, None], peak[i] + j], np.arange(FILTERS)[None, :]), part)
                    g[f"t{k}"] = gk
                step += 1
                for k, a in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    a -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """Softmax of each window. Pairs of bytes are looked up at once in tables of 65,536 rows."""
        if not hasattr(self, "pairs"):
            two = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
            t = self.p
            self.pairs = two(*t["t2"]), two(*t["t3"][:2]), t["t3"][2], two(*t["t4"][:2]), two(*t["t4"][2:])
        a2, a3, b3, a4, b4 = self.pairs
        out = np.empty((len(x), len(self.langs)), np.float32)
        for s in range(0, len(x), block):
            xb = x[s : s + block]
            pair = (xb[:, :-1].astype(np.int32) << 8) | xb[:, 1:]
            r3 = a3.take(pair[:, :-1], axis=0)
            r3 += b3.take(xb[:, 2:], axis=0)
            r4 = a4.take(pair[:, :-2], axis=0)
            r4 += b4.take(pair[:, 2:], axis=0)
            h = np.concatenate([a2.take(pair, axis=0).max(1), r3.max(1), r4.max(1)], 1) + self.p["b"]
            z = np.maximum(h, 0) @ self.p["u"] + self.p["c"]
            z = np.exp(z - z.max(1, keepdims=True))
            out[s : s + block] = z / z.sum(1, keepdims=True)
        return out


def train(docs: DataFrame, max_docs: int = 2000, windows_each: int = 4, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """Fit a ByteNet on at most max_docs labelled rows outside fold 0, the first by hash of their id.

    windows_each windows are cut evenly from each whole text. None if no row is labelled.
    """
    b = utf8(F.col(text_col))
    step = F.floor(F.greatest(F.octet_length(b) - WINDOW, F.lit(0)) / max(1, windows_each - 1))
    cut = F.transform(F.array(*[F.lit(i) for i in range(windows_each)]), lambda i: F.substring(b, (i * step + 1).cast("int"), F.lit(WINDOW)))
    learnable = docs.where((remainder(id_col, folds) != 0) & F.col(lang_col).isNotNull())
    rows = bounded_sample(learnable, id_col, max_docs).where(F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), cut.alias("cut")).collect()
    rows.sort(key=lambda r: (r.lang, [bytes(c) for c in r.cut]))
    if not rows:
        return None
    langs = sorted({r.lang for r in rows})
    cuts = [(bytes(c), langs.index(r.lang)) for r in rows for c in dict.fromkeys(bytes(c) for c in r.cut)]
    x, _, _ = windows(np.frombuffer(b"".join(c for c, _ in cuts), np.uint8), np.cumsum([0, *(len(c) for c, _ in cuts)]))
    return ByteNet(langs).fit(x, np.array([y for _, y in cuts]))


def identify(docs: DataFrame, net: ByteNet | None, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """docs with the predicted language of each whole text and its probability.

    Every byte is seen: the text's windows are classified and their probabilities averaged by their bytes. Texts
    that are null or have no letter are `und` with score 0, as is all text if there is no network.
    The columns named in out replace any of that name; of the others those in keep stay (None: all).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out and c != "_bytes"]
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    x = docs.select(*keep, F.when(letters, utf8(F.col(text_col))).otherwise(F.lit(b"")).alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("_bytes"))
            n, total = len(offsets) - 1, None
            langs, score = np.full(n, "und", object), np.zeros(n)
            if net is not None and len(data):
                total = np.zeros((n, len(net.langs)))
                cuts = [0, *(np.searchsorted(offsets, np.arange(1, 1 + int(offsets[-1]) // (1 << 22)) << 22)), n]  # some MB at a time
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi > lo and offsets[hi] > offsets[lo]:
                        w, text, used = windows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                        p = net.probabilities(w) * used[:, None]
                        at = np.flatnonzero(np.diff(text, prepend=-1))
                        total[lo + text[at]] = np.add.reduceat(p, at, axis=0)
                size = np.diff(offsets)
                some = size > 0
                total[some] /= size[some, None]
                langs[some] = np.array(net.langs, object)[total[some].argmax(1)]
                score[some] = np.minimum(total[some].max(1), 1.0)
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(score)], [*keep, *out])

    schema = x.select(*keep, F.lit("").alias(out[0]), F.lit(0.0).alias(out[1])).schema
    return x.mapInArrow(run, schema)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs)
    return identify(docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text"), net, keep=["doc_id", "held_out"])
