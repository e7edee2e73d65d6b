"""Tags, metadata filters, index summaries, logs, deletion and versions of a document table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_any_tag(df: DataFrame, tags: str, wanted: Sequence[str]) -> DataFrame:
    """Rows that have one of the tags exactly."""
    return df.where(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted])))


def with_tag_part(df: DataFrame, tags: str, part: str) -> DataFrame:
    """Rows with a tag that contains the text, case-insensitive."""
    return df.where(F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(part.lower()))))


def filters(extensions: Sequence[str] = (), path_part: str | None = None, after=None, before=None, path: str = "path", modified: str = "modified") -> Column:
    """Conjunction of file type, path and inclusive date filters."""
    out = F.lit(True)
    if extensions:
        out = out & F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions])
    if path_part:
        out = out & F.contains(F.lower(path), F.lit(path_part.lower()))
    if after is not None:
        out = out & (F.col(modified) >= after)
    if before is not None:
        out = out & (F.col(modified) <= before)
    return out


def tag_coverage(index: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """rows, tagged, untagged and the tagged share in percent; tags has (key, tag)."""
    has = tags.select(key).distinct().withColumn("_t", F.lit(1))
    x = index.join(has, key, "left").agg(F.count(F.lit(1)).alias("rows"), F.count("_t").alias("tagged"))
    return x.select("rows", "tagged", (F.col("rows") - F.col("tagged")).alias("untagged"), F.round(100 * F.col("tagged") / F.col("rows"), 2).alias("percent"))


def by_month(df: DataFrame, at: str) -> DataFrame:
    return df.groupBy(F.date_format(F.col(at).cast("timestamp"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def delete_paths(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table without the keys in gone, to be written beside the old one and swapped."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def renamed(df: DataFrame, names: dict, key: str) -> DataFrame:
    out = F.col(key)
    for old, new in names.items():
        out = F.when(F.col(key) == old, F.lit(new)).otherwise(out)
    return df.withColumn(key, out)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and of old those whose key new lacks."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def page_furniture(lines: DataFrame, doc: str, page: str, line: str, edge: str, most_words: int = 8) -> DataFrame:
    """Edge lines of few words that stand on more than half of a document's pages (two at least): headers and footers."""
    pages = lines.groupBy(doc).agg(F.count_distinct(page).alias("_pages"))
    x = lines.where(F.col(edge) & (F.size(F.split(F.trim(line), r"\s+")) <= most_words))
    n = x.groupBy(doc, line).agg(F.count_distinct(page).alias("_n"))
    return n.join(pages, doc).where(F.col("_n") >= F.greatest(F.lit(2), F.floor(F.col("_pages") / 2) + 1)).select(doc, line)


def invoice_totals(lines: DataFrame, invoice: str, quantity: str, price: str, vat: str, stated: str) -> DataFrame:
    """net, tax and gross of each invoice and whether the stated total agrees to less than one unit."""
    net = F.sum(F.col(quantity) * F.col(price))
    tax = F.sum(F.col(quantity) * F.col(price) * F.col(vat) / 100)
    return lines.groupBy(invoice).agg(net.alias("net"), tax.alias("tax"), (net + tax).alias("gross"), (F.abs(net + tax - F.max(stated)) < 1).alias("agrees"))


def long_form(tables: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """(dataset, variable, value) of the numeric columns of several tables, nulls left out."""
    out = None
    for name, df in tables.items():
        x = df.select(F.lit(name).alias("dataset"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["dataset"], list(columns), "variable", "value").where("value is not null")
        out = x if out is None else out.unionByName(x)
    return out
