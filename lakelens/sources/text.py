"""Text of files and pages: small per-row parsers behind Arrow-batched functions."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class PageText(HTMLParser):
    """Title, headings and paragraphs; scripts, styles and navigation left out."""

    def __init__(self) -> None:
        super().__init__()
        self.skip, self.keep, self.parts = 0, 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style", "nav", "footer", "noscript")
        if tag in ("title", "p", "h1", "h2", "h3", "h4", "h5"):
            self.keep = 1
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "nav", "footer", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("title", "p", "h1", "h2", "h3", "h4", "h5"):
            self.keep = 0

    def handle_data(self, data: str) -> None:
        if self.keep and not self.skip:
            self.parts.append(data)


def page_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = PageText()
    p.feed(html)
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def mail_text(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = page_text(text) or ""
    return "\n".join([*(f"{h}: {m[h]}" for h in ("From", "To", "Subject", "Date") if m[h]), text.strip()])


def zipped_text(raw: bytes | None) -> str | None:
    """Paragraphs of office and book files: every text node of the XML parts that hold the body."""
    if raw is None:
        return None
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        return None
    out = []
    for name in sorted(z.namelist()):
        if re.search(r"word/document\.xml|slides/slide\d+\.xml|content\.xml|sharedStrings\.xml|\.xhtml$", name):
            for node in ElementTree.fromstring(z.read(name)).iter():
                if re.search(r"\}(p|si|h\d?)$", node.tag):
                    out.append("".join(node.itertext()).strip())
    return "\n".join(x for x in out if x)


def html_to_text(c: str | Column) -> Column:
    return F.pandas_udf(lambda s: s.map(page_text), "string")(c)


def mail_to_text(c: str | Column) -> Column:
    return F.pandas_udf(lambda s: s.map(mail_text), "string")(c)


def office_to_text(c: str | Column) -> Column:
    return F.pandas_udf(lambda s: s.map(zipped_text), "string")(c)


def edit_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths, the score of fuzzy term matching."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def fuzzy_score(c: str | Column, word: str) -> Column:
    """Score of each term of a vocabulary against a word; applied to distinct terms, not to tokens."""
    return F.pandas_udf(lambda s: s.map(lambda t: edit_ratio(t, word)), "double")(c)
