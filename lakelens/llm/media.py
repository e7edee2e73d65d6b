"""Media columns: interleaved sequences of text and media references parsed from HTML, payloads joined by digest."""

from __future__ import annotations

import hashlib
import io
import re
import wave
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lakelens.llm.common import stage, utf8

BLOCK = 64
HEAD = {"title", "base", "link", "meta", "style", "script", "noscript", "template"}
SKIP = {"script", "style", "nav", "noscript", "template", "head", "title"}
BREAKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "hr", "figure", "figcaption", "blockquote", "pre", "body", "nav"}
MEDIA = {"img": "image", "audio": "audio", "video": "video"}
NESTED = (SKIP | BREAKS | {"audio", "video"}) - {"br", "hr"}
NAMES = ("position", "kind", "text", "ref", "digest", "caption")
ITEMS = ArrayType(StructType([StructField(n, IntegerType() if n == "position" else StringType()) for n in NAMES]))


def col(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def squeezed(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


class Interleaved(HTMLParser):
    """Text and media references in reading order: (kind, text, ref, caption).

    A caption is the figure's figcaption, wherever it stands in the figure, else the tag's alt or title text; the
    figcaption of a figure without media is text. End tags may be missing: an end tag closes what is open inside
    its element, a block closes the paragraph it stands in, body, a flow tag or text closes head, and the end of
    the page closes all. Audio and video without src take their first source.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.open: list[tuple[str, int]] = []  # nested tags and where their items begin
        self.count: Counter[str] = Counter()
        self.captions: list[tuple[int, list[str]]] = []  # of the open figures
        self.skip = 0

    def flush(self) -> None:
        if text := squeezed(self.text):
            self.items.append(["text", text, None, None])
        self.text.clear()
        if self.caption is not None:
            self.caption.append(" ")

    def pop(self) -> str:
        tag, start = self.open.pop()
        self.count[tag] -= 1
        if tag in SKIP:
            self.skip -= 1
        if tag in BREAKS:
            self.flush()
        if tag == "figcaption" and self.caption is not None:
            self.captions[-1][1].append(squeezed(self.caption))
            self.caption = None
        elif tag == "figure" and not self.skip:
            _, parts = self.captions.pop()
            media = [x for x in self.items[start:] if x[0] != "text"]
            for x in media:
                x[3] = " ".join(filter(None, parts)) or x[3]
            if not media:
                self.items.extend(["text", x, None, None] for x in parts if x)
        return tag

    def pop_through(self, tag: str) -> None:
        if self.count[tag]:
            while self.pop() != tag:
                pass

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        if self.count["head"] and (tag == "body" or (tag not in HEAD and self.open[-1][0] in ("head", "title"))):
            self.pop_through("head")
        if tag in BREAKS:
            if self.open and self.open[-1][0] == "p":
                self.pop()
            self.flush()
        if tag in MEDIA and not self.skip and values.get("src"):
            self.flush()
            self.items.append([MEDIA[tag], None, values["src"], values.get("alt") or values.get("title") or None])
        elif tag == "source" and not self.skip and self.open and self.open[-1][0] in ("audio", "video") and self.open[-1][1] == len(self.items) and values.get("src"):
            self.flush()
            self.items.append([MEDIA[self.open[-1][0]], None, values["src"], None])
        if tag in NESTED:
            if tag == "figure" and not self.skip:
                self.captions.append((len(self.items), []))
            elif tag == "figcaption" and self.captions and not self.skip and self.caption is None:
                self.caption = []
            # items of a tag with its own src begin before that src, so its sources are left out
            self.open.append((tag, len(self.items) - (tag in MEDIA and bool(values.get("src")))))
            self.count[tag] += 1
            self.skip += tag in SKIP

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in NESTED:
            self.pop_through(tag)
        if tag in BREAKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.pop()
        if self.skip:
            return
        (self.text if self.caption is None else self.caption).append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self.pop()
        self.flush()


def parse(html: str) -> list[tuple]:
    """The page's sequence, positions counted from 0; a ref that ends in sha256:<hex> carries its digest."""
    p = Interleaved()
    p.feed(html)
    p.close()
    return [(i, kind, text, ref, m[1] if ref and (m := re.search(r"sha256:([0-9a-f]{64})$", ref)) else None, caption) for i, (kind, text, ref, caption) in enumerate(p.items)]


def sequences(pages: DataFrame, html_col: str = "html", items_col: str = "items") -> DataFrame:
    """Each page's row with its interleaved sequence in one array beside its other columns, in place of the HTML.

    Null and empty pages have an empty array. The page's columns may have any names but items_col.
    """
    keep = [f for f in pages.schema if f.name != html_col]
    if any(f.name == items_col for f in keep):
        raise ValueError(f"the pages have a column {items_col!r} already; name another items_col")
    kind = pa.list_(pa.struct([(n, pa.int32() if n == "position" else pa.string()) for n in NAMES]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [[dict(zip(NAMES, x, strict=True)) for x in parse(html.as_py() or "")] for html in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(items, kind)], [*(f.name for f in keep), items_col])

    out = StructType([*keep, StructField(items_col, ITEMS)])
    return pages.select(*[col(c).alias(f"_{i}") for i, c in enumerate([*(f.name for f in keep), html_col])]).mapInArrow(run, out)


def media_items(pages: DataFrame, items_col: str = "items") -> DataFrame:
    """One row a media reference of each sequence, its struct in the column item beside the page's other columns.

    Positions stay those of the whole page. A page without media has no row.
    """
    rest = [col(c) for c in pages.columns if c != items_col]
    return pages.select(*rest, F.explode(F.filter(F.col(items_col), lambda x: x["kind"] != "text")).alias("item"))


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """Join the media table's columns, in one struct media, to the references by digest; unknown digests keep null.

    media has one row a digest. A digest that very many items share is a skewed join key, which Spark splits.
    """
    m = media.select(F.col("digest").alias("_digest"), F.struct(*[col(c) for c in media.columns]).alias("media"))
    return items.join(m, items["item.digest"] == m["_digest"], "left").drop(m["_digest"])


def padded(text: Column) -> Column:
    """UTF-8 bytes with bytes 0 appended up to a positive multiple of 64."""
    b = utf8(text)
    n = F.octet_length(b)
    return F.concat(b, F.unhex(F.repeat(F.lit("00"), F.when(n == 0, BLOCK).otherwise((BLOCK - n % BLOCK) % BLOCK))))


def to_wave(payload: bytes) -> bytes:
    """Mono 8-bit PCM; every payload byte is one sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, 8000, 0, "NONE", "not compressed"))
        w.writeframes(payload)
    return out.getvalue()


def from_wave(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def features(samples: np.ndarray) -> str:
    """Mean, root mean square about 128, crossings of 128 and peak: exact sums, so equal payloads give equal text."""
    x = samples.astype(np.int64) - 128
    return f"mean={x.sum() / len(x):.6f};rms={np.sqrt((x * x).sum() / len(x)):.6f};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};peak={int(np.abs(x).max())}"


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Write every text's payload as a WAV file in a media table (digest, media) and read the table back.

    A batch stores a payload once; the same payload may be stored by several tasks, so read it by digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unique = {hashlib.sha256(p).digest(): p for p in (x.as_py() for x in batch.column(0))}
            yield pa.RecordBatch.from_arrays([pa.array([k.hex() for k in unique]), pa.array([to_wave(p) for p in unique.values()], pa.binary())], ["digest", "media"])

    return stage(docs.select(padded(F.col(text_col)).alias("payload")).mapInArrow(run, "digest string, media binary"), "media")


def describe(media: DataFrame) -> DataFrame:
    """What is read back from each stored file, one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                stored = x.as_py()
                p = from_wave(stored)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), features(np.frombuffer(p, np.uint8))))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["digest", *names])

    out = media.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.groupBy("digest").agg(*[F.min(c).alias(c) for c in out.columns[1:]])


def as_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as a page: its lines as paragraphs, then its media reference with a caption."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    safe = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    digest = F.sha2(padded(F.col(text_col)), 256)
    html = F.concat(
        F.lit("<article><p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit('</p><figure><img src="media:sha256:'), digest,
        F.lit('"><figcaption>document '), F.coalesce(F.col(id_col).cast("string"), F.lit("?")), F.lit("</figcaption></figure></article>"),
    )
    return docs.select(F.col(id_col), F.octet_length(utf8(F.col(text_col))).cast("long").alias("n_bytes"), html.alias("html"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, null and empty text as 64 bytes 0; rows that repeat each have their row.

    n_items and text_chars count the whole sequence of the document's page, position and caption are its media item's.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chars = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.char_length(x["text"]), F.lit(0)))
    pages = sequences(as_pages(docs)).select("doc_id", "n_bytes", F.size("items").alias("n_items"), chars.alias("text_chars"), "items")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return resolve(media_items(pages), describe(store(docs))).select("doc_id", "n_bytes", *[f"media.{c}" for c in names], "item.position", "item.caption", "n_items", "text_chars")
