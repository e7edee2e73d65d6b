"""Cleaning: schema decisions from one inference job, then one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.scalar import parse_date
from lakelens.operators.aggregates import clean_number, numeric_columns
from lakelens.operators.quantiles import median, quantiles

IDENTIFIERS = ("id", "code", "key", "zip", "postal", "phone")
DATE_HINTS = ("date", "time", "timestamp", "created", "modified", "day")


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def infer_columns(df: DataFrame, numeric_share: float = 0.8, date_share: float = 0.3) -> dict[str, str]:
    """What each text column should become: double, timestamp or string, decided in one aggregation.

    A column is numeric if more than numeric_share of its values parse and its name is no identifier's; a date if its
    name hints at one and at least date_share of its values parse.
    """
    cols = text_columns(df)
    if not cols:
        return {}
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    share = lambda c, parsed: F.avg(F.when(some(c).isNotNull(), parsed.isNotNull().cast("double")))
    row = df.agg(*[share(c, F.col(c).try_cast("double")).alias(f"n{i}") for i, c in enumerate(cols)], *[share(c, parse_date(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        named = any(h in c.lower() for h in IDENTIFIERS)
        if (row[f"n{i}"] or 0) > numeric_share and not named:
            out[c] = "double"
        elif any(h in c.lower() for h in DATE_HINTS) and (row[f"d{i}"] or 0) >= date_share:
            out[c] = "timestamp"
        else:
            out[c] = "string"
    return out


def coerce(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Text columns cast as inferred; what does not parse becomes null."""
    kinds = infer_columns(df) if kinds is None else kinds
    cast = {"double": lambda c: clean_number(F.col(c).try_cast("double")), "timestamp": parse_date, "string": F.col}
    return df.select(*[cast[kinds.get(c, "string")](c).alias(c) for c in df.columns])


def fill_missing(df: DataFrame, how: str = "mean", columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls replaced: numbers by mean, median or zero (integers by the rounded value), text by its least mode.

    A column without any value stays null. Medians are read off running counts and modes off counts, so no task holds a
    column's values.
    """
    columns = list(columns or df.columns)
    numbers = [c for c in numeric_columns(df) if c in columns]
    texts = [c for c in text_columns(df) if c in columns]
    row: dict = {}
    if numbers and how == "median":
        long = df.select(*[clean_number(c).alias(c) for c in numbers]).unpivot([], numbers, "column", "value")
        row |= {r.column: r.median for r in median(long, "value", ["column"]).collect()}
    elif numbers:
        f = {"mean": F.avg, "zero": lambda c: F.when(F.count(c) > 0, F.lit(0.0))}[how]
        row |= df.agg(*[f(clean_number(c)).alias(c) for c in numbers]).first().asDict()
    if texts:
        counts = df.select(*texts).unpivot([], texts, "column", "value").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        row |= {r.column: r.b.value for r in counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b")).collect()}
    out = []
    for c, t in df.dtypes:
        v = row.get(c)
        if v is None:
            out.append(F.col(c))
        elif t in ("double", "float"):
            out.append(F.coalesce(clean_number(c), F.lit(v)).cast(t).alias(c))
        elif c in numbers:
            out.append(F.coalesce(F.col(c), F.round(F.lit(v)).cast(t)).alias(c))
        else:
            out.append(F.coalesce(F.col(c), F.lit(v)).alias(c))
    return df.select(*out)


def cleaning_report(df: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(column, nulls_before, nulls_after, filled, note) of every column."""
    nulls = lambda x: x.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in x.columns]).unpivot([], x.columns, "column", "n")
    x = nulls(df).withColumnRenamed("n", "nulls_before").join(nulls(cleaned).withColumnRenamed("n", "nulls_after"), "column")
    note = F.when(F.col("nulls_after") > 0, "preserved missing values").when(F.col("nulls_before") > 0, "filled").otherwise("complete")
    return x.select("column", "nulls_before", "nulls_after", (F.col("nulls_before") - F.col("nulls_after")).alias("filled"), note.alias("note"))


def normalise(df: DataFrame, columns: Sequence[str], how: str = "zscore") -> DataFrame:
    """Columns by z-score or min-max; a spread of 0 counts as 1."""
    a, b = (F.avg, F.stddev_samp) if how == "zscore" else (F.min, lambda c: F.max(c) - F.min(c))
    row = df.agg(*[a(c).alias(f"a_{c}") for c in columns], *[b(c).alias(f"b_{c}") for c in columns]).first()
    if not columns or all(row[f"a_{c}"] is None for c in columns):
        return df
    return df.select(*[((F.col(c) - row[f"a_{c}"]) / (row[f"b_{c}"] or 1.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def drop_outliers(df: DataFrame, columns: Sequence[str], how: str = "iqr", limit: float | None = None) -> DataFrame:
    """Rows without outliers, column after column: later columns see what earlier ones left. Nulls stay."""
    for c in columns:
        if how == "iqr":
            q1, q3 = quantiles(df.select(clean_number(c).alias("v")), "v", {"q1": 0.25, "q3": 0.75}).first() or (None, None)
            k = 1.5 if limit is None else limit
            lo, hi = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        else:
            m, s = df.agg(F.avg(c), F.stddev_samp(c)).first()
            k = 3.0 if limit is None else limit
            lo, hi = (None, None) if not s else (m - k * s, m + k * s)
        if lo is not None:
            df = df.where(F.col(c).isNull() | F.col(c).between(lo, hi))
    return df
