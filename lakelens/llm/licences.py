"""Licence scans by a positional index of rare template words. DataFrame functions only.

One pass over the texts keeps, of every document, the positions of the words that some template or phrase has; all else
works on those positions. Each template is indexed under the words of its that fewest documents have. Where several of
them stand in a file as far from one another as in the template, the template's mandatory phrases must stand there too.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.common import discard, stage

#: What separates words once A-Z are lower-cased: ASCII but for 0-9 and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence notice: its label, its words, and phrases that must stand in any copy of it."""

    label: str
    text: str
    phrases: tuple[str, ...]


#: Phrases that are licence marks by themselves, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Function words, which are never looked up.
FUNCTION_WORDS = "a an and any are as at be by for from in is it its not of on or that the this to under with you your".split()
#: Public notices in their usual wording.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2.0", ("apache license", "2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0", ("www apache org licenses license 2 0",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("software without restriction", "associated documentation files")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("without fee", "hereby granted provided")),
    Template("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("binary forms", "disclaimer")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("promote products", "specific prior written permission")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0", ("mozilla public license",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", ("creative commons attribution sharealike 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4.0", ("cc by nc",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", ("eclipse public license",)),
    Template("bsl-1.0", "distributed under the boost software license version 1.0", ("boost software license",)),
)


def words_of(text: str) -> list[str]:
    """The words of a template, by the rule for texts."""
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


def rows_of(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


def scanned(docs: DataFrame, vocabulary: Sequence[str], phrases: Sequence[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, n_words, hits, n_base, first_word, last_word, base): one pass over the texts.

    hits are (at, word), the places of the vocabulary's words in order; phrases are looked for among them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1).alias("w"))
    # A separator at either end leaves an empty string there; the text without words is one empty string.
    ahead = (F.get("w", F.lit(0)) == "").cast("int")
    behind = ((F.size("w") > 1) & (F.get("w", F.size("w") - 1) == "")).cast("int")
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(*vocabulary))
    x = x.select("doc_id", "h", ahead.alias("ahead"), (F.size("w") - ahead - behind).cast("long").alias("n_words"), "w", places.alias("places"))
    x = x.select("doc_id", "h", "n_words", F.transform("places", lambda i: F.struct((i - F.col("ahead")).alias("at"), F.get("w", i).alias("word"))).alias("hits"))

    def starts(words: list[str]) -> Column:
        """Where the words stand one after the other: the places of those hits whose next hits are the next words."""
        hit = lambda k: F.get("hits", k)
        at = lambda k: reduce(Column.__and__, [(hit(k + j)["word"] == w) & (hit(k + j)["at"] == hit(k)["at"] + j) for j, w in enumerate(words)])
        last = F.size("hits") - len(words)
        return F.when(last >= 0, F.transform(F.filter(F.sequence(F.lit(0), last), at), lambda k: hit(k)["at"])).otherwise(F.array().cast("array<int>"))

    x = x.select("*", *[starts(words_of(p)).alias(f"s{i}") for i, (p, _) in enumerate(phrases)])
    all_ = F.flatten(F.array(*[f"s{i}" for i in range(len(phrases))]))
    labels = F.array_compact(F.array(*[F.when(F.size(f"s{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    return x.select("doc_id", "h", "n_words", "hits", F.size(all_).cast("long").alias("n_base"), F.array_min(all_).cast("long").alias("first_word"), F.array_max(all_).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"))


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = BASE, rare: int = 12, share: float = 0.75, drift: int = 8, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    A template is looked up by its `rare` words of fewest documents (all, if it has fewer; function words never). It is
    found where at least `share` of those words stand at relative positions that differ by no more than `drift` words
    from the template's, and all its mandatory phrases as well. labels has the base labels and those of all templates
    found. score is 1 where a base phrase stands, else the largest share of looked-up words of a template found, else 0.

    A null text counts as empty; an empty text has no words and no labels; long texts are read whole; repeated rows and
    ids, null ones too, get a row each; words of equal document frequency rank by their letters; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    split = [words_of(t.text) for t in templates]
    vocabulary = sorted({w for ws in split for w in ws if w not in FUNCTION_WORDS} | {w for p, _ in phrases for w in words_of(p)} | {w for t in templates for p in t.phrases for w in words_of(p)})
    docs_ = stage(scanned(docs, vocabulary, phrases, id_col, text_col), "licence-hits")

    # The index: of each template the words that fewest documents have.
    seen = docs_.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    first = {(t, w): p for t, ws in reversed([*enumerate(split)]) for p, w in reversed([*enumerate(ws)]) if w not in FUNCTION_WORDS}
    posted = rows_of(spark, [(t, w) for t, w in sorted(first)], ["t", "word"]).join(F.broadcast(seen), "word", "left")
    posted = posted.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(F.coalesce("df", F.lit(0)), "word"))).where(F.col("rank") <= rare)
    places = rows_of(spark, [(t, w, p) for t, ws in enumerate(split) for p, w in enumerate(ws) if (t, w) in first], ["t", "word", "p"])
    sizes = posted.groupBy("t").agg(F.count(F.lit(1)).alias("of"))
    index = stage(posted.select("t", "word").join(places, ["t", "word"]).join(sizes, "t"), "licence-index")

    # Hits on indexed words, by template and relative position. A cell is 2 * drift wide; two grids, half a cell apart.
    able = F.size(F.array_distinct(F.transform("hits", lambda x: x["word"])))
    least = index.groupBy("t").agg(F.ceil(F.first("of") * share).alias("n")).agg(F.min("n")).first()[0] or 1
    some = docs_.where(able >= least).select("doc_id", "h", "hits").dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.inline("hits"))
    some = stage(some, "licence-places")
    cells = lambda d: F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((d + g * drift) / (2 * drift)).alias("cell")) for g in (0, 1)])).alias("c")
    key = ["doc_id", "h", "t", "c"]
    votes = some.join(F.broadcast(index), "word").select("doc_id", "h", "t", "word", "of", cells(F.col("at") - F.col("p"))).groupBy(*key, "of").agg(F.count_distinct("word").alias("n"))
    votes = votes.where(F.col("n") >= F.ceil(F.col("of") * share))

    # Mandatory phrases, each at the place where the template has it first.
    parts, needed = [], []
    for t, (template, ws) in enumerate(zip(templates, split, strict=True)):
        for k, p in enumerate(map(words_of, template.phrases)):
            at = next(i for i in range(len(ws)) if ws[i : i + len(p)] == p)
            parts += [(t, k, j, w, at, len(p)) for j, w in enumerate(p)]
        needed.append((t, len(template.phrases)))
    phrase = rows_of(spark, parts, ["t", "k", "j", "word", "p", "len"])
    stand = some.join(F.broadcast(phrase), "word").groupBy("doc_id", "h", "t", "k", "len", "p", (F.col("at") - F.col("j")).alias("start")).agg(F.count_distinct("j").alias("n")).where("n = len")
    stand = stand.select("doc_id", "h", "t", "k", cells(F.col("start") - F.col("p"))).groupBy(*key).agg(F.count_distinct("k").alias("stand"))
    found = votes.alias("v").join(stand.alias("s"), F.expr(" and ".join(f"v.{c} <=> s.{c}" for c in key))).select("v.*", "stand")
    found = found.join(F.broadcast(rows_of(spark, needed, ["t", "phrases"])), "t").where("stand = phrases")
    found = found.join(F.broadcast(rows_of(spark, [(t, x.label) for t, x in enumerate(templates)], ["t", "label"])), "t")
    found = found.groupBy("doc_id", "h").agg(F.collect_set("label").alias("more"), F.max(F.col("n") / F.col("of")).alias("share"))
    found = stage(found, "licence-found")

    x = docs_.select("doc_id", "h", "n_words", "n_base", "first_word", "last_word", "base", able.alias("able")).alias("d")
    plain = x.where(F.col("able") < least).withColumn("more", F.array().cast("array<string>")).withColumn("share", F.lit(0.0)).drop("h", "able")
    rich = x.where(F.col("able") >= least).join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.h = f.h"), "left")
    rich = rich.select("d.doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("more", F.array().cast("array<string>")).alias("more"), F.coalesce("share", F.lit(0.0)).alias("share"))
    return plain.unionByName(rich).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("share")).alias("score")
    )


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values(rows: Sequence[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_SPLIT = [words_of(t.text) for t in TEMPLATES]
OP12_SQL = rf"""
with t(t, label) as (values {_values([(t, x.label) for t, x in enumerate(TEMPLATES)])}),
pl(t, p, word) as (values {_values([(t, p, w) for t, ws in enumerate(_SPLIT) for p, w in enumerate(ws) if w not in FUNCTION_WORDS])}),
ph(t, k, words, p) as (values {_values([(t, k, " ".join(words_of(p)), " ".join(_SPLIT[t]).split(" ".join(words_of(p)))[0].count(" ")) for t, x in enumerate(TEMPLATES) for k, p in enumerate(x.phrases)])}),
base(words, label) as (values {_values(BASE)}),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
vocabulary as (select distinct word from pl union select unnest(string_split(words, ' ')) from ph union select unnest(string_split(words, ' ')) from base),
h as (select r, pos - 1 as pos, word from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d) where word in (from vocabulary)),
df as (select word, count(distinct r) as df from h group by word),
rare as (select t, word from (select t, word, row_number() over (partition by t order by coalesce(df, 0), word) as i from (select distinct t, word from pl) left join df using (word)) where i <= 12),
sizes as (select t, count(*) as n from rare group by t),
grids as (select unnest([0, 1]) as grid),
votes as (select r, t, grid, floor((pos - p + grid * 8) / 16.0) as cell, count(distinct word) as n from h join pl using (word) join rare using (t, word), grids group by all),
starts as (select distinct h.r, ph.t, ph.k, pos - p as delta from h join ph on h.word = split_part(words, ' ', 1) join d on d.r = h.r
  where array_to_string(w[pos + 1 : pos + len(string_split(words, ' '))], ' ') = words),
stand as (select r, t, grid, floor((delta + grid * 8) / 16.0) as cell, count(distinct k) as k from starts, grids group by all),
found as (select r, label, v.n / sizes.n as share from votes v join sizes using (t) join stand s using (r, t, grid, cell) join t using (t)
  where v.n >= ceil(sizes.n * 0.75) and s.k = (select count(*) from ph where ph.t = v.t)),
b as (select h.r, pos, label from h join base on h.word = split_part(words, ' ', 1) join d on d.r = h.r where array_to_string(w[pos + 1 : pos + len(string_split(words, ' '))], ' ') = words),
bs as (select r, count(*) as n, min(pos) as lo, max(pos) as hi, string_agg(distinct label, ',' order by label) as labels from b group by r),
ls as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from b union select r, label from found) group by r),
fs as (select r, max(share) as share from found group by r)
select doc_id, len(w)::bigint as n_words, coalesce(bs.n, 0) as n_base, lo as first_word, hi as last_word, coalesce(bs.labels, '') as base_labels, coalesce(ls.labels, '') as labels,
  case when bs.n > 0 then 1.0::double else coalesce(share, 0)::double end as score
from d left join bs using (r) left join ls using (r) left join fs using (r)
"""
