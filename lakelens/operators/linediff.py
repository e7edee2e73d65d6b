"""Comparison of texts: what changed, by how much, and line by line as a table function."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lakelens.operators.observe import similarity

#: Bytes beyond which texts are not compared line by line unless asked for.
LARGE = 2 << 20
ROW = "hunk int, old_no int, new_no int, sign string, line string"


def halves(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """The stretch of equal lines in the middle of a shortest edit script of a[a0:a1] and b[b0:b1], by search from both ends.

    Returned as its start and end (i, j, i2, j2). The two searches keep one furthest place a diagonal, so memory grows
    with the lines, not with their product.
    """
    n, m = a1 - a0, b1 - b0
    shift = n - m
    ahead, back = {1: 0}, {1: 0}  # by diagonal: the furthest i from the start, and from the end
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            i = ahead[k + 1] if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead[k - 1] + 1
            j = i - k
            i_, j_ = i, j
            while i < n and j < m and a[a0 + i] == b[b0 + j]:
                i, j = i + 1, j + 1
            ahead[k] = i
            if shift % 2 and abs(shift - k) < d and i + back.get(shift - k, -1) >= n and j <= m and i_ <= n and j_ >= 0:
                return a0 + i_, b0 + j_, a0 + i, b0 + j
        for k in range(-d, d + 1, 2):
            i = back[k + 1] if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            j = i - k
            i_, j_ = i, j
            while i < n and j < m and a[a1 - 1 - i] == b[b1 - 1 - j]:
                i, j = i + 1, j + 1
            back[k] = i
            if not shift % 2 and abs(shift - k) <= d and i + ahead.get(shift - k, -1) >= n and j <= m and i_ <= n and j_ >= 0:
                return a1 - i, b1 - j, a1 - i_, b1 - j_
    raise AssertionError("the searches always meet")


def edit_script(a: Sequence, b: Sequence) -> Iterator[tuple[str, int, int]]:
    """(sign, i, j) of a shortest script: " " for a[i] == b[j], "-" for a[i], "+" for b[j]; removals come before additions."""
    todo = [(0, len(a), 0, len(b))]
    gone: list[int] = []
    come: list[int] = []

    def flush(i: int, j: int) -> Iterator[tuple[str, int, int]]:
        yield from (("-", x, j - len(come)) for x in gone)
        yield from (("+", i, y) for y in come)
        gone.clear()
        come.clear()

    while todo:
        a0, a1, b0, b1 = todo.pop()
        start = a0
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        if a0 > start:
            yield from flush(start, b0 - a0 + start)
            yield from ((" ", i, b0 - a0 + i) for i in range(start, a0))
        end = 0
        while a1 - end > a0 and b1 - end > b0 and a[a1 - 1 - end] == b[b1 - 1 - end]:
            end += 1
        if end:
            todo.append((a1 - end, a1, b1 - end, b1))
            a1, b1 = a1 - end, b1 - end
        if a0 == a1 or b0 == b1:
            gone += range(a0, a1)
            come += range(b0, b1)
        else:
            i, j, i2, j2 = halves(a, b, a0, a1, b0, b1)
            todo.append((i, a1, j, b1))
            todo.append((a0, i, b0, j))
    yield from flush(len(a), len(b))


@udtf(returnType=ROW, useArrow=True)
class LineDiff:
    """line_diff(old, new, context): the changed lines of two texts with `context` lines about them, as rows.

    Lines that belong together share a hunk, counted from 1; old_no and new_no count lines from 1 and are null for lines
    that the text lacks. A last line without a newline is noted by a row of sign \\ and the text's name. Null counts as
    a text without lines.
    """

    def eval(self, old: str, new: str, context: int):
        a, b = ((t or "").splitlines() for t in (old, new))
        number = {line: n for n, line in enumerate(dict.fromkeys([*a, *b]))}  # lines are compared as numbers
        script = list(edit_script([number[x] for x in a], [number[x] for x in b]))
        changed = [n for n, s in enumerate(script) if s[0] != " "]
        hunk, last = 0, -1
        for n in changed:
            lo = max(n - context, last + 1)
            if hunk == 0 or lo > last + 1:
                hunk += 1
            for k in range(lo, min(n + context + 1, len(script))):
                if k > n and script[k][0] != " ":
                    break
                sign, i, j = script[k]
                yield hunk, None if sign == "+" else i + 1, None if sign == "-" else j + 1, sign, b[j] if sign == "+" else a[i]
                last = k
        if changed:
            for t, name in ((old, "old"), (new, "new")):
                if t and not t.endswith(("\n", "\r")):
                    yield hunk, None, None, "\\", name


def changed(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """(key, old, new) of the keys of either table whose texts differ; a null text is one without lines, a missing key too.

    Digests are compared first, so only texts that differ are shuffled. Rows with a null key are left out.
    """
    a, b = a.where(F.col(key).isNotNull()), b.where(F.col(key).isNotNull())
    digest = lambda d, n: d.select(key, F.md5(F.coalesce(text, F.lit(""))).alias(n))
    keys = digest(a, "_a").join(digest(b, "_b"), key, "full").where(~F.coalesce("_a", F.md5(F.lit(""))).eqNullSafe(F.coalesce("_b", F.md5(F.lit(""))))).select(key)
    side = lambda d, n: d.select(key, F.col(text).alias(n)).join(keys, key, "left_semi")
    return side(a, "old").join(side(b, "new"), key, "full").select(F.col(key).alias("key"), "old", "new")


def line_diff(a: DataFrame, b: DataFrame, key: str, text: str, context: int = 3, limit: int | None = LARGE) -> DataFrame:
    """(key, hunk, old_no, new_no, sign, line): `LineDiff` of every changed pair of texts of at most `limit` bytes each (None: all)."""
    x = changed(a, b, key, text)
    if limit is not None:
        x = x.where(F.greatest(F.coalesce(F.octet_length("old"), F.lit(0)), F.coalesce(F.octet_length("new"), F.lit(0))) <= limit)
    x.sparkSession.udtf.register("line_diff", LineDiff)
    return x.sparkSession.sql(f"select key, d.* from {{x}}, lateral line_diff(old, new, {int(context)}) d", x=x)


def compare_texts(a: DataFrame, b: DataFrame, key: str, text: str, threshold: float | None = None, limit: int = LARGE) -> DataFrame:
    """(key, status, ratio, similar) of every key: identical, changed, large (over `limit` bytes, no ratio), missing_a or missing_b.

    similar: the ratio of matching characters is at least 1 - threshold; without a threshold it is null.
    """
    x = changed(a, b, key, text)
    large = F.greatest(F.coalesce(F.octet_length("old"), F.lit(0)), F.coalesce(F.octet_length("new"), F.lit(0))) > limit
    x = x.select("key", large.alias("large"), F.when(~large, F.col("old")).alias("old"), F.when(~large, F.col("new")).alias("new"))
    ratio = similarity("old", "new")
    x = x.select("key", "large", ratio.alias("ratio"))
    has = lambda d, n: d.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(True).alias(n))
    every = has(a, "_a").join(has(b, "_b"), "key", "full").join(x, "key", "left")
    status = F.when(F.col("_a").isNull(), "missing_a").when(F.col("_b").isNull(), "missing_b").when(F.col("large").isNull(), "identical").when(F.col("large"), "large").otherwise("changed")
    both = F.when(status == "identical", 1.0).when(status == "changed", F.col("ratio"))
    return every.select("key", status.alias("status"), both.alias("ratio"), (both >= F.lit(None if threshold is None else 1 - threshold).cast("double")).alias("similar"))
