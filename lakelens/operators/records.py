"""Log lines, tags, metadata, fields of documents, observer events and saved searches as columns and aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of document headers and the pattern of each one's value.
LABELS = {
    "kunde": r"\bKunde[:\.]?\s*([^\n\r|;,]{2,120})",
    "key-nr": r"\bKey[-‐–]?Nr[:\.]?\s*([A-Z0-9][A-Z0-9\-/ ]{1,40})",
    "erstellt von": r"\bErstellt von[:\.]?\s*([^\n\r|;,]{2,80})",
    "bereich": r"\bBereich[:\.]?\s*([^\n\r|;,]{2,120})",
    "erstellt am": r"\bErstellt am[:\.]?\s*(\d{2}\.\d{2}\.\d{2,4})",
    "version kunde": r"\bVersion Kunde[:\.]?\s*(V?\s*[\d\.]+)",
    "patch": r"\bPatch[:\.]?\s*([A-Z0-9.\-]{1,20})",
}
# Patterns of patient fields, labelled ones first, then the loose one.
HEALTH = {
    "patient_name": [r"(?im)Patient Name[:\-]\s*(.+)", r"(?im)Name[:\-]\s*(.+)", r"\b([A-Z][a-z]+(?:[-\s][A-Z][a-z]+){1,3})\b"],
    "dob": [r"(?im)(?:DOB|Date of Birth)[:\-]\s*(.+)", r"(\b\d{2}/\d{2}/\d{4}\b|\b\d{4}-\d{2}-\d{2}\b)"],
    "address": [r"(?im)Address[:\-]\s*(.+)", r"(\d{1,5}\s[\w\s,.-]{1,50})"],
    "case_number": [r"(?im)(?:Case|Record)\s*#[:\-]?\s*(\w+)", r"(?i)\b(?:Case|Record)\s*#\s*[:#]?\s*(\w+)\b"],
}
# Metadata keys that say what a file is about; the others are technical.
SEMANTIC = ["title", "subject", "author", "keywords", "comments", "description", "category"]
DATES = [r"\d{4}-\d{2}-\d{2}", r"\d{2}\.\d{2}\.\d{4}", r"\d{2}/\d{2}/\d{4}"]


def log_entries(lines: DataFrame, line: str) -> DataFrame:
    """ts, path, file, extension and, for .../year/month/customer/file, year, month and customer of each log line.

    The path is what follows the last "]" of a line that has "] ", else the whole line; empty lines are left out.
    """
    rest = F.when(F.contains(F.col(line), F.lit("] ")), F.regexp_extract(line, r"(?s)([^\]]*)$", 1)).otherwise(F.col(line))
    raw = F.trim(F.regexp_replace(rest, r"[\\/]+", "/"))
    parts = F.split(F.col("path"), "/")
    deep = (F.size(parts) >= 5) & F.element_at(parts, -4).rlike(r"^\d{4}$") & F.element_at(parts, -3).rlike(r"^\d+$")
    x = lines.where(F.trim(line) != "").withColumn("ts", F.regexp_extract(line, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", 0)).withColumn("path", raw)
    x = x.withColumn("ts", F.expr("try_to_timestamp(nullif(replace(ts, 'T', ' '), ''))")).withColumn("file", F.element_at(parts, -1))
    x = x.withColumn("extension", F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1)))
    return x.select("*", *[F.when(deep, F.element_at(parts, at)).alias(name) for name, at in (("year", -4), ("month", -3), ("customer", -2))])


def log_summary(entries: DataFrame, log: str, top: int = 20) -> dict[str, DataFrame]:
    """Entries by log, the customers with most entries and the paths that stand more than once."""
    n = F.count(F.lit(1)).alias("n")
    customers = entries.groupBy(F.coalesce("customer", F.lit("UNKNOWN")).alias("customer")).agg(n)
    return {
        "logs": entries.groupBy(log).agg(n, F.min("ts").alias("first"), F.max("ts").alias("last")),
        "customers": customers.orderBy(F.desc("n"), "customer").limit(top),
        "repeated": entries.groupBy("path").agg(n).where("n > 1"),
    }


def retained(entries: DataFrame, at: str, days: int, now: str | Column) -> DataFrame:
    """Rows not older than `days` before `now`; of a table partitioned by day this is a partition filter."""
    return entries.where(F.col(at) >= F.date_sub((F.lit(now) if isinstance(now, str) else now).cast("date"), days))


def _clean(value: Column) -> Column:
    flat = F.regexp_replace(value, r"[​ \s]+", " ")
    return F.regexp_replace(F.regexp_replace(flat, r"^[ .:\-]+|[ .:\-]+$", ""), r"\s*,\s*", " ")


def virtual_tags(text: str | Column, meta: Column | None = None) -> Column:
    """Sorted "label: value" tags, lower-case, of a text's labelled fields; a label for which meta has a value of two signs or more is taken from there."""
    text = F.col(text) if isinstance(text, str) else text
    tag = lambda k, v: F.when(F.length(v) > 1, F.lower(F.concat(k, F.lit(": "), v)))
    found = [tag(F.lit(k), _clean(F.regexp_extract(text, f"(?i){p}", 1))) for k, p in LABELS.items()]
    if meta is None:
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    some = F.filter(F.map_entries(meta), lambda e: (F.length(_clean(e["key"])) > 1) & (F.length(_clean(e["value"])) > 1))
    keys = F.coalesce(F.transform(some, lambda e: F.lower(_clean(e["key"]))), F.array().cast("array<string>"))
    rest = [F.when(~F.array_contains(keys, k), f) for k, f in zip(LABELS, found, strict=True)]
    given = F.transform(F.map_entries(meta), lambda e: tag(_clean(e["key"]), _clean(e["value"])))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce(given, F.array().cast("array<string>")), F.array(*rest)))))


def metadata_tiers(meta: str | Column, semantic: Sequence[str] = SEMANTIC) -> list[Column]:
    """A map split in two: semantic texts and technical values, the technical ones that are numbers also as doubles."""
    m = F.col(meta) if isinstance(meta, str) else meta
    about = lambda k: F.lower(k).isin(*semantic)
    technical = F.map_filter(m, lambda k, v: ~about(k))
    number = F.map_filter(F.transform_values(technical, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    return [F.map_filter(m, lambda k, v: about(k)).alias("semantic"), technical.alias("technical"), number.alias("numbers")]


def query_pairs(query: str | Column) -> Column:
    """Map of the key:value words of a metadata query; of equal keys the last one counts."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: w.rlike(r"^[^:]+:.+$"))
    pairs = F.transform(words, lambda w: F.struct(F.lower(F.substring_index(w, ":", 1)).alias("key"), F.regexp_extract(w, "^[^:]+:(.+)$", 1).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def dates_in(text: str | Column) -> Column:
    """All dates of the known forms, in the order of the forms."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in DATES]))


def health_fields(text: str | Column) -> list[Column]:
    """Patient fields: the first labelled form found, else the loose pattern; null if none."""
    flat = F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\t"), F.lit(" "))
    first = lambda p: F.nullif(F.trim(F.regexp_extract(flat, p, 1)), F.lit(""))
    return [F.coalesce(*[first(p) for p in patterns]).alias(name) for name, patterns in HEALTH.items()]


def identity(path: str | Column, folder: str = "Patients", given: str | Column | None = None) -> list[Column]:
    """identity: a given value, the folder below `folder`, or the number in the file's name; entity_key: the name's stem."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    below = F.nullif(F.regexp_extract(p, rf"(?:^|/){folder}/([^/]+)", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(name, r"(?i)(?:patient[_-]?id|pid)[_-]?(\d+)", 1), F.lit(""))
    known = [] if given is None else [F.col(given) if isinstance(given, str) else given]
    return [F.coalesce(*known, below, number).alias("identity"), F.lower(F.regexp_replace(name, r"(.)\.[^.]*$", "$1")).alias("entity_key")]


def event_summary(events: DataFrame, kind: str, column: str) -> DataFrame:
    """Events of each kind: count and the sorted distinct columns concerned, whose number the schema bounds."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(column)).alias("columns"))


def observer_metrics(runs: DataFrame, observer: str, ms: str, events: str, failed: str) -> DataFrame:
    return runs.groupBy(observer).agg(F.count(F.lit(1)).alias("runs"), F.avg(ms).alias("avg_ms"), F.sum(events).alias("events"), F.count_if(failed).alias("errors"))


def wanted_events(events: DataFrame, observer: str, kind: str, ignored: Mapping[str, Sequence[str]]) -> DataFrame:
    """Events without the kinds that their observer ignores."""
    drop = F.lit(False)
    for name, kinds in ignored.items():
        drop = drop | ((F.col(observer) == name) & F.col(kind).isin(*kinds))
    return events.where(~F.coalesce(drop, F.lit(False)))


def audit(events: DataFrame, who: str, wanted: str, at: str) -> DataFrame:
    """An identity's events in order of time."""
    return events.where(F.col(who) == wanted).orderBy(at)


def first_and_last(snapshots: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """first and last value of each key by time."""
    return snapshots.groupBy(key).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))


def token_distribution(docs: DataFrame, text: str, top: int = 50) -> DataFrame:
    """The most frequent words, split at white space, over all texts."""
    n = docs.select(F.explode(F.split(F.trim(text), r"\s+")).alias("token")).where("token != ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "token").limit(top)


def text_volume(docs: DataFrame, text: str, by: str) -> DataFrame:
    return docs.groupBy(by).agg(F.count(text).alias("texts"), F.sum(F.length(text)).alias("chars"), F.avg(F.length(text)).alias("mean_chars"))


def cache_rows(cache: str | Column) -> Column:
    """Rows of a search cache, a JSON object of key to {timestamp, results: [{path, snippet, tags}]}; use with inline."""
    result = "array<struct<path string, snippet string, tags array<string>>>"
    entries = F.map_entries(F.from_json(cache, f"map<string, struct<timestamp double, results {result}>>"))
    each = lambda e: F.transform(e["value"]["results"], lambda r: F.struct(e["key"].alias("cache_key"), e["value"]["timestamp"].alias("timestamp"), r["path"].alias("path"), r["snippet"].alias("snippet"), r["tags"].alias("tags")))
    return F.flatten(F.transform(entries, each))


def saved_matches(results: DataFrame, words: str, columns: Sequence[str]) -> DataFrame:
    """Saved results that hold the words in one of the columns, case-insensitive."""
    return results.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(words.lower())))


def sentence_snippet(text: str | Column, word: str, around: int = 2) -> Column:
    """The first sentence with the word and `around` sentences on both sides; null if there is none."""
    s = F.split(text, r"(?<=[.!?])\s+")
    at = F.array_position(F.transform(s, lambda x: F.contains(F.lower(x), F.lit(word.lower()))), True).cast("int")
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(s, start, at + around - start + 1), " "))


def slug(text: str | Column) -> Column:
    """Lower-case ASCII words joined by hyphens; accents go, as do letters without an ASCII base."""
    return F.trim(F.regexp_replace(F.lower(F.pandas_udf(_ascii, "string")(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def _ascii(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def date_column(df: DataFrame, hint: str | None = None) -> str | None:
    """The column to take as time: a hint valid in more than half, a date type, the name that parses best (half at least), a text in date form (0.4)."""
    words = ["date", "time", "timestamp", "created", "modified", "day"]  # fixed values
    valid = {c: F.expr(f"try_cast(`{c}` as timestamp)").isNotNull() for c, t in df.dtypes if t in ("string", "date") or t.startswith("timestamp")}
    if not valid:
        return None
    form = r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{1,2}\.\d{1,2}\.\d{4}\b"
    row = df.agg(*[F.avg(v.cast("double")).alias(f"v{i}") for i, v in enumerate(valid.values())], *[F.avg(F.coalesce(F.col(c).cast("string").rlike(form), F.lit(False)).cast("double")).alias(f"f{i}") for i, c in enumerate(valid)]).first()
    share = {c: (row[f"v{i}"] or 0.0, row[f"f{i}"] or 0.0) for i, c in enumerate(valid)}
    if hint in share and share[hint][0] > 0.5:
        return hint
    typed = [c for c, t in df.dtypes if t == "date" or t.startswith("timestamp")]
    if typed:
        return typed[0]
    best = max((c for c in share if any(w in c.lower() for w in words)), key=lambda c: share[c][0], default=None)
    if best and share[best][0] >= 0.5:
        return best
    return next((c for c, (v, f) in share.items() if f > 0 and v > 0.4), None)


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, columns that one lacks as null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def known_paths(tables: Sequence[DataFrame], path: str) -> DataFrame:
    """Each path that one of the tables has, once."""
    return union_all([t.select(path) for t in tables]).distinct()


def lagged(df: DataFrame, value: str, by: str, order: Sequence[str], k: int = 1) -> DataFrame:
    """`value` and its value k rows before within a series."""
    return df.withColumn("lagged", F.lag(value, k).over(Window.partitionBy(by).orderBy(*order)))
