"""Column functions: text cleaning, tags, metadata, dates, transforms, path facets, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in order; single letters also parse leading zeros.
DATE_FORMATS = ("yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy", "d.M.yyyy", "M/d/yyyy")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: str | Column) -> Column:
    """Tags to spaces, control characters dropped, white space collapsed and trimmed."""
    x = F.regexp_replace(col(c), r"<[^>]+>", " ")
    x = F.regexp_replace(x, r"\s+", " ")
    return F.trim(F.regexp_replace(x, r"[\x00-\x1F\x7F-\x9F]", ""))


def clean_tags(tags: str | Column) -> Column:
    """An array of tags: ; to :, white space collapsed, empty ones and repeats dropped, order kept."""
    x = F.transform(col(tags), lambda t: F.trim(F.regexp_replace(F.replace(t, F.lit(";"), F.lit(":")), r"\s+", " ")))
    return F.array_distinct(F.filter(x, lambda t: t != ""))


def merge_tags(old: str | Column, new: str | Column) -> Column:
    return F.array_sort(F.array_union(col(old), col(new)))


def remove_tags(old: str | Column, gone: str | Column) -> Column:
    return F.array_sort(F.array_except(col(old), col(gone)))


def semantic_filter(c: str | Column) -> Column:
    """Tokens of three characters or more that are not all digits, joined by a space."""
    return F.array_join(F.filter(F.split(col(c), r"\s+"), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$")), " ")


def weighted_text(metadata: str | Column, weights: dict[str, int], default: int = 1) -> Column:
    """key:value of a map's entries, each as often as its weight, keys in order."""
    weight = F.lit(default)
    entries = F.array_sort(F.map_entries(col(metadata)))

    def repeat(e: Column) -> Column:
        w = weight
        for k, n in weights.items():
            w = F.when(e["key"] == k, n).otherwise(w)
        return F.array_repeat(F.concat(e["key"], F.lit(":"), e["value"]), w)

    return F.array_join(F.flatten(F.transform(entries, repeat)), " ")


def parse_date(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first format that parses, as timestamp; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(col(c)), F.lit(f)) for f in formats])


def date_parts(c: str | Column, prefix: str) -> list[Column]:
    t = col(c).cast("timestamp")
    parts = {
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "weekday": F.date_format(t, "EEEE"), "hour": F.hour(t), "quarter": F.quarter(t), "month_name": F.date_format(t, "MMMM"),
        "week": F.weekofyear(t), "day_of_year": F.dayofyear(t), "minute": F.minute(t), "iso": F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), "epoch": F.unix_seconds(t),
    }
    return [v.alias(f"{prefix}_{k}") for k, v in parts.items()]


def transform_number(c: str | Column, how: str) -> Column:
    """log (log1p), sqrt, softplus or exp_log of a number, negatives clipped to 0 for log and sqrt."""
    x = col(c).cast("double")
    up = F.greatest(x, F.lit(0.0))
    soft = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return {"none": x, "log": F.log1p(up), "sqrt": F.sqrt(up), "softplus": soft, "exp_log": F.expm1(F.log1p(up))}[how]


def transform_for(skew: str | Column) -> Column:
    """The transform's name that a skewness asks for."""
    s = col(skew)
    return F.when(s > 3, "log").when(s > 1, "sqrt").when(s < -1, "softplus").otherwise("none")


def path_facets(c: str | Column) -> list[Column]:
    """name, extension, folder, year (19xx or 20xx) and month of a path."""
    p = F.regexp_replace(F.regexp_replace(col(c), r"\\", "/"), "/+$", "")
    name = F.element_at(F.split(p, "/"), -1)
    day = F.regexp_extract(p, r"((?:19|20)\d{2})[-_/](\d{2})", 0)
    return [
        name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.regexp_extract(p, "^(.*)/", 1).alias("folder"),
        F.nullif(F.substring(day, 1, 4), F.lit("")).alias("year"), F.nullif(F.substring(day, -2, 2), F.lit("")).alias("month"),
    ]


def net_date(c: str | Column) -> Column:
    """Timestamps as /Date(milliseconds)/ or ISO text."""
    ms = F.regexp_extract(col(c), r"^/Date\((-?\d+)", 1)
    return F.when(ms != "", F.timestamp_millis(ms.try_cast("long"))).otherwise(F.try_to_timestamp(col(c)))


def json_safe(c: str | Column) -> Column:
    """A double without NaN and infinities."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def decimal_degrees(degrees: str | Column, minutes: str | Column, seconds: str | Column, ref: str | Column) -> Column:
    x = col(degrees) + col(minutes) / 60 + col(seconds) / 3600
    return F.when(F.upper(col(ref)).isin("S", "W"), -x).otherwise(x)


def regex_match(c: str | Column, pattern: str) -> Column:
    """Case-insensitive and false on null."""
    return F.coalesce(col(c).rlike(f"(?i){pattern}"), F.lit(False))
