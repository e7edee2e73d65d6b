"""The divergence audit against a plain count of everything."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lakelens.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, tf string, chunk string, n string, item string"


def table(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", "u", "v") for r in rows], DOCS)


def brute(rows, least=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        tf = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                tf[d[1]].update(t for t in d[2] if df[t] >= least)
        total = sum(tf.values(), Counter())
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: p_of(c) for s, c in tf.items()}, p_of(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in tf:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in tf if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if tf[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, o.decode(), -v, i) for i, (v, o) in enumerate(items, 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(rng, sources, n=300):
    words = [a + b for a in ("Ba", "co", "dÿ", "fu", "É") for b in ("lan", "mér", "nit", "X")] + ["hapax", "l'eau", "x2y"]
    return [(i, prose(rng, words[rng.randrange(3) :], rng.randrange(1, 20)), rng.choice(["en", "fr", None]), f"s{min(rng.randrange(sources), rng.randrange(sources))}") for i in range(n)]


def test_random_documents_equal_a_plain_count(spark):
    rows = corpus(random.Random(1), 6)
    assert got(divergence.audit(table(spark, rows).repartition(4))) == brute(rows)


def test_blocks_chunks_and_spans_agree_with_one_block(spark, monkeypatch):
    rows = corpus(random.Random(2), 13)
    for name, v in (("BLOCK", 3), ("CHUNK", 4), ("SPAN", 2)):
        monkeypatch.setattr(divergence, name, v)
    assert got(divergence.audit(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "1 2 3", "en", "b"), (4, "word " * 30000, "en", None), (4, "word " * 30000, "en", None), (None, "Word wORD", "en", "c"), (7, "word", "xx", "a"), (8, "", "xx", "b")]
    rows += [(i, "word tie tei", "en", "d") for i in range(20, 32)]
    assert got(divergence.audit(table(spark, rows))) == brute(rows)


def test_empty_table_and_least_docs(spark):
    assert got(divergence.audit(table(spark, []))) == []
    rows = corpus(random.Random(4), 3, 40)
    assert got(divergence.audit(table(spark, rows), least_docs=1)) == brute(rows, 1)


def test_counts_do_not_depend_on_what_is_held_or_on_pieces(monkeypatch):
    rng = random.Random(5)
    rows = corpus(rng, 4, 60) + [(99, "lang " * 500 + "x" * 300 + " Ende", "en", "s0")]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[2] or "" for r in part]), pa.array([r[3] for r in part]), pa.array([r[1].encode() for r in part], pa.binary())], ["lang", "source", "text"])

    def total():
        out = Counter()
        for b in divergence.counted(iter([batch(rows[:20]), batch(rows[20:])])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"], "tf"] += r["tf"]
                out[r["lang"], r["source"], r["term"], "df"] += r["df"]
        return out

    plain = total()
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert total() == plain


def test_probabilities_of_huge_counts_are_exact():
    counts = [0, 1, 10**12, 3 * 10**14 + 7]
    n, v = 10**15, 10**6
    assert divergence.probabilities(np.array(counts), np.array(n), np.array(v)).tolist() == [1 + 10**9 * (c + 2) // (n + 2 * v) for c in counts]
