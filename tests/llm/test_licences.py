"""The licence scan against a plain search of every template in every text."""

import math
import random
import re
from collections import Counter, defaultdict

from lakelens.llm import licences
from lakelens.llm.licences import BASE, FUNCTION_WORDS, TEMPLATES, Template, words_of

DOCS = "doc_id long, text string, word string, hits string, t int, label string, h long"
TEXTS = [x.text for x in TEMPLATES]


def table(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2) for r in rows], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(w, phrase):
    return [i for i in range(len(w) - len(phrase) + 1) if w[i : i + len(phrase)] == phrase]


def brute(rows, templates=TEMPLATES, rare=12, share=0.75, drift=8):
    texts = [words(t) for _, t in rows]
    df = Counter(w for t in texts for w in set(t))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        at = {label: places(w, p.split()) for p, label in BASE}
        base = {label for label in at if at[label]}
        every = sorted(x for v in at.values() for x in v)
        labels, best = set(base), 0.0
        for t in templates:
            ws = words_of(t.text)
            keys = sorted({x for x in ws if x not in FUNCTION_WORDS}, key=lambda x: (df[x], x))[:rare]
            cells, stand = defaultdict(set), defaultdict(set)
            for g in (0, 1):
                for k in keys:
                    for a in (a for a, x in enumerate(w) if x == k):
                        for p in (p for p, x in enumerate(ws) if x == k):
                            cells[g, (a - p + g * drift) // (2 * drift)].add(k)
                for p in t.phrases:
                    for a in places(w, words_of(p)):
                        stand[g, (a - places(ws, words_of(p))[0] + g * drift) // (2 * drift)].add(p)
            good = [len(v) for c, v in cells.items() if len(v) >= math.ceil(len(keys) * share) and len(stand[c]) == len(t.phrases)]
            if good:
                labels.add(t.label)
                best = max(best, max(good) / len(keys))
        out.append((-1 if i is None else i, len(w), len(every), every[0] if every else -1, every[-1] if every else -1, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels, r.labels, r.score) for r in df.collect())


def test_random_texts_equal_a_plain_search(spark):
    rng = random.Random(1)
    filler = "lan mer nit license software version public the by cc all rights 2 0 free".split()
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(TEXTS).split()
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(["", "(c)", "Foo bar", "x y z", t[0]])
            parts += [" ".join(t).title(), " ".join(rng.choice(filler) for _ in range(rng.randrange(12)))]
        rows.append((i, rng.choice(["", " ", "-- "]) + "\n".join(parts) + rng.choice(["", ".", " "])))
    result = got(licences.scan(table(spark, rows).repartition(3)))
    assert result == brute(rows)
    assert len({r[6] for r in result}) > 20


def test_every_template_is_found_in_itself_and_not_in_parts(spark):
    rows = [(i, "before it, " * 3 + t.upper()) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(sorted(words_of(t)))) for i, t in enumerate(TEXTS)]
    result = {r[0]: r for r in got(licences.scan(table(spark, rows)))}
    for i, x in enumerate(TEMPLATES):
        assert x.label in result[i][6].split(",") and result[i][7] == 1.0
        assert x.label not in result[100 + i][6].split(",")


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "  . "), (4, "CC-BY cc by"), (None, "cc by"), (None, "cc by"), (5, "word " * 30000 + "All rights\nreserved."), (5, "mit license"), (5, "mit license"), (6, "Kcc by İ all rights reserveD"),
        (7, "Released under the MIT License. " * 500), (8, "xcc by, cc byx, all  right reserved"), (9, "é cc by"), (10, "general public general public license"),
    ]
    assert got(licences.scan(table(spark, rows))) == brute(rows)


def test_empty_table_and_own_templates(spark):
    assert got(licences.scan(table(spark, []))) == []
    own = (Template("house", "alpha beta gamma delta epsilon", ("beta gamma",)),)
    rows = [(1, "alpha beta gamma delta"), (2, "alpha gamma beta delta epsilon"), (3, "alpha one beta gamma two delta three epsilon")]
    assert got(licences.scan(table(spark, rows), templates=own)) == brute(rows, own) and [r[6] for r in brute(rows, own)] == ["house", "", "house"]


def test_no_python_in_the_plan(spark):
    x = licences.scan(table(spark, [(1, "cc by")]))
    assert not re.search("Python|Pandas|Arrow", x._jdf.queryExecution().toString())
