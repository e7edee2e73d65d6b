"""Full-text search as DataFrame work: postings, boolean, phrase, proximity and regex queries, BM25 ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.sources.text import fuzzy_score

if TYPE_CHECKING:
    from lakelens.operators.textindex import TextIndex

TOKEN = r"[\p{L}\p{N}]+"
#: Terms that are grouped at a time.
RUN = 200_000


def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, key, tf, positions) of every row (key, terms), in batches of bounded size."""
    for batch in batches:
        keys, lists = batch.column(0), batch.column(1)
        size = np.diff(lists.offsets.to_numpy()).astype("int64")
        run = np.cumsum(size) // RUN  # rows of a run have about RUN terms, or one row more
        for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(run)) + 1):
            n = size[rows]
            if not n.sum():
                continue
            terms = lists.slice(rows[0], len(rows)).flatten().dictionary_encode()
            code, doc = terms.indices.to_numpy().astype("int64"), np.repeat(rows, n)
            place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
            order = np.argsort(doc * len(terms.dictionary) + code, kind="stable")
            code, doc, place = code[order], doc[order], place[order]
            first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            at = np.append(first, len(code))
            positions = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[first])), keys.take(pa.array(doc[first])), pa.array(np.diff(at), pa.int64()), positions], ["term", "key", "tf", "positions"])


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, positions), the index to write and reuse, partitioned or bucketed by term.

    Words are grouped where their text is; only if some key has several texts are its postings shuffled and merged.
    """
    terms = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    x = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), terms.alias("terms"))
    x = x.mapInArrow(by_text, f"term string, key {docs.schema[key].dataType.simpleString()}, tf long, positions array<int>")
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        return x
    return x.groupBy("term", "key").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def vocabulary(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, docs, occurrences)."""
    return postings(docs, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


@dataclass(frozen=True)
class Node:
    """A parsed query: term, phrase, prefix and near hold words; and, or and not hold nodes."""

    kind: str
    parts: tuple = ()
    distance: int = 0


def parse(query: str) -> Node:
    """A query without upper-case operators, quotes, parentheses or * is one phrase.

    AND, OR, NOT (binary: a NOT b), NEAR(a b, n), "phrase", pre*, parentheses; words side by side mean AND, which
    binds tightest, then NOT, AND, OR. Lower-case operator words are words.
    """
    words_of = lambda s: tuple(w.lower() for w in re.findall(r"[^\W_]+", s))
    if not re.search(r"\b(AND|OR|NOT|NEAR)\b|[\"()*]", query):
        words = words_of(query)
        if not words:
            raise ValueError("the query has no word")
        return Node("phrase", words)
    found = re.findall(r'NEAR\s*\([^)]*\)|"[^"]*"|[()]|[^\W_]+\*?', query)
    at = 0

    def peek() -> str | None:
        return found[at] if at < len(found) else None

    def take() -> str:
        nonlocal at
        at += 1
        return found[at - 1]

    def atom() -> Node:
        t = peek()
        if t is None or t in ("AND", "OR", "NOT", ")"):
            raise ValueError(f"a word is missing in {query!r}")
        take()
        if t == "(":
            n = either()
            if peek() != ")":
                raise ValueError("a parenthesis is not closed")
            take()
            return n
        if t.startswith("NEAR"):
            inside = t[t.index("(") + 1 : -1]
            m = re.fullmatch(r"(.*?)(?:,\s*(\d+))?\s*", inside, re.S)
            return Node("near", words_of(m[1]), int(m[2] or 10))
        if t.startswith('"'):
            return Node("phrase", words_of(t))
        return Node("prefix", (t[:-1].lower(),)) if t.endswith("*") else Node("phrase", (t.lower(),))

    def beside() -> Node:
        parts = [atom()]
        while peek() not in (None, "AND", "OR", "NOT", ")"):
            parts.append(atom())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def without() -> Node:
        n = beside()
        while peek() == "NOT":
            take()
            n = Node("not", (n, beside()))
        return n

    def both() -> Node:
        parts = [without()]
        while peek() == "AND":
            take()
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def either() -> Node:
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    n = either()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r}")
    return n


def leaves(n: Node) -> list[Node]:
    return [n] if n.kind in ("phrase", "prefix", "near") else [x for p in n.parts for x in leaves(p)]


def occurrences(leaf: Node, at: Column) -> Column:
    """Number of places where a leaf occurs, given the row's map from term to positions."""
    if leaf.kind == "prefix":
        hits = F.map_filter(at, lambda k, v: k.startswith(leaf.parts[0]))
        return F.aggregate(F.map_values(hits), F.lit(0), lambda s, v: s + F.size(v))
    places = [F.coalesce(F.element_at(at, F.lit(w)), F.array().cast("array<int>")) for w in leaf.parts]
    back = lambda i: lambda x: x - i
    ok = places[0]
    for i, p in enumerate(places[1:], 1):
        if leaf.kind == "phrase":
            hits = F.transform(p, back(i))
        else:
            hits = F.flatten(F.transform(p, lambda x: F.sequence(x - leaf.distance - 1, x + leaf.distance + 1)))
        ok = F.array_intersect(ok, hits)
    return F.size(ok)


def matches(n: Node, found: dict[Node, Column]) -> Column:
    if n in found:
        return found[n] > 0
    parts = [matches(p, found) for p in n.parts]
    if n.kind == "not":
        return parts[0] & ~parts[1]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if n.kind == "and" else out | p
    return out


def search(docs: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents that match, by BM25 over the query's phrases; a phrase is one unit.

    Only terms of the query leave the scan, as one map of positions a document; document lengths, their mean and the
    frequencies of the few units are aggregated once.
    """
    tree = parse(query)
    units = list(dict.fromkeys(leaves(tree)))
    words = sorted({w for u in units if u.kind != "prefix" for w in u.parts})
    prefixes = [u.parts[0] for u in units if u.kind == "prefix"]
    all_ = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    x = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), all_.alias("terms"))
    wanted = lambda t: t.isin(*words) if not prefixes else t.isin(*words) | t.rlike("^(" + "|".join(prefixes) + ")")
    pairs = F.filter(F.transform("terms", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda p: wanted(p["t"]))
    x = x.select("key", F.size("terms").alias("len"), pairs.alias("pairs"))
    distinct = F.array_distinct(F.transform("pairs", lambda p: p["t"]))
    at = F.map_from_arrays(distinct, F.transform(distinct, lambda t: F.transform(F.filter("pairs", lambda p: p["t"] == t), lambda p: p["i"])))
    x = x.withColumn("at", at).select("key", "len", *[occurrences(u, F.col("at")).alias(f"u{i}") for i, u in enumerate(units)])
    stats = x.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avglen"), *[F.count_if(F.col(f"u{i}") > 0).alias(f"d{i}") for i in range(len(units))])
    x = x.where(matches(tree, {u: F.col(f"u{i}") for i, u in enumerate(units)})).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(units)):
        idf = F.greatest(F.lit(1e-6), F.ln((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)))
        tf = F.col(f"u{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avglen")))
    return x.select("key", score.alias("score"))


def regex_search(docs: DataFrame, key: str, text: str, pattern: str, context: int = 30) -> DataFrame:
    """(key, at, snippet): the first match, case-insensitive, with `context` characters on both sides."""
    p = F.lit(f"(?i){pattern}")
    at = F.regexp_instr(F.col(text), p)
    hit = F.regexp_extract(F.col(text), f"(?i){pattern}", 0)
    start = F.greatest(at - context, F.lit(1))
    return docs.where(F.col(text).rlike(f"(?i){pattern}")).select(F.col(key).alias("key"), at.alias("at"), F.substring(F.col(text), start, at - start + F.length(hit) + context).alias("snippet"))


def unchanged(index: DataFrame, files: DataFrame) -> DataFrame:
    """Files (path, hash) that the index lacks or has with another hash: what is to be indexed again."""
    return files.join(index.select("path", "hash"), ["path", "hash"], "left_anti")


def snippet(text: Column | str, words: Sequence[str], around: int = 8, most: int = 3) -> Column:
    """Pieces of the text: each word that holds one of `words` (case ignored) with `around` words on both sides.

    Pieces that meet are one; the first `most` are joined by " ... ". Null if there is none.
    """
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, r"\s+")
    holds = lambda w: reduce(Column.__or__, [F.contains(F.lower(w), F.lit(x.lower())) for x in words])
    hits = F.filter(F.transform(parts, lambda w, i: F.when(holds(w), i)), lambda i: i.isNotNull())
    # Runs (from, to) of word numbers: a hit within reach of the last run's end moves that end.
    runs = F.aggregate(
        hits, F.array().cast("array<struct<a:int,b:int>>"),
        lambda s, i: F.when((F.size(s) > 0) & (F.get(s, F.size(s) - 1)["b"] >= i - around - 1), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.get(s, F.size(s) - 1)["a"].alias("a"), (i + around).alias("b")))))
        .when(F.size(s) > most, s).otherwise(F.concat(s, F.array(F.struct(F.greatest(i - around, F.lit(0)).alias("a"), (i + around).alias("b"))))),
    )
    pieces = F.transform(F.slice(runs, 1, most), lambda r: F.trim(F.array_join(F.slice(parts, r["a"] + 1, r["b"] - r["a"] + 1), " ")))
    return F.when(F.size(pieces) > 0, F.array_join(pieces, " ... "))


def ranked(
    docs: DataFrame, key: str, text: str, query: str, condition: Column | None = None, meta: DataFrame | None = None, order: str = "relevance", modified: str | None = None, path: str | None = None, around: int = 8, index: TextIndex | None = None
) -> DataFrame:
    """Rows of docs that match the query and the condition, with score and snippet, in one of four orders.

    Matches and scores come from the index if one is given, else from a scan of the texts, and are those of the whole
    table; the condition may use columns of `meta`, joined by key (documents without a row there are left out). Orders:
    relevance, newest, oldest, path; ties by score, then key.
    """
    by = {"relevance": [], "newest": [F.desc_nulls_last(modified)] if modified else None, "oldest": [F.asc_nulls_last(modified)] if modified else None, "path": [F.lower(path)] if path else None}
    if by.get(order) is None:
        raise ValueError(f"cannot order by {order!r}")
    words = sorted({w for leaf in leaves(parse(query)) for w in leaf.parts})
    rows = docs if meta is None else docs.join(meta, key)
    if condition is not None:
        rows = rows.where(condition)
    hits = (index.search(query) if index else search(docs, key, text, query)).withColumnRenamed("key", key)
    return rows.join(hits, key).withColumn("snippet", snippet(text, words, around)).orderBy(*by[order], F.desc("score"), key)


def search_or_fuzzy(docs: DataFrame, key: str, text: str, query: str, least: float = 80.0, top: int = 5) -> DataFrame:
    """(key, score): the query's matches; where it has none, what matches any word that starts with one of the `top` most similar terms.

    Similarity is twice the longest common subsequence of the whole query and a term over both lengths, in percent.
    """
    hits = search(docs, key, text, query)
    if not hits.isEmpty():
        return hits
    terms = close_terms(vocabulary(docs, key, text), query.strip().lower(), least, top)
    return search(docs, key, text, " OR ".join(f"{t}*" for t in terms)) if terms else hits


def close_terms(vocabulary: DataFrame, word: str, least: float = 80.0, top: int = 5) -> list[str]:
    """The vocabulary's terms most like a word, best first; terms whose length alone rules them out are not scored."""
    n = len(word)
    within = F.length("term").between(n * least / (200 - least), n * (200 - least) / least)
    x = vocabulary.where(within).select("term").withColumn("share", fuzzy_score("term", word)).where(F.col("share") >= least)
    return [r.term for r in x.orderBy(F.desc("share"), "term").limit(top).collect()]
