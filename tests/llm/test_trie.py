"""The prefix trie against a plain trie of lists."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lakelens.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth string, conv string, k1 string, part int, words double"


def table(spark, rows):
    """Turns with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 0.5) for r in rows], TURNS)


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, role, hashlib.sha256((hashlib.sha256(role.encode()).hexdigest() + text).encode()).digest(), text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = turns.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, x in made.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = sum(saved[k] for k in children[path]) + (len(members[path]) - 1) * n
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if made[c] == list(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def check(spark, rows):
    assert got(trie.conversation_trie(table(spark, rows).repartition(3))) == brute(rows)


def test_random_conversations_equal_a_plain_trie(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot"]), " ".join(rng.choice("ab") for _ in range(rng.randrange(3)))) for c in rng.sample(range(-30, 90), 70) for t in range(rng.randrange(1, 7))]
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(0, None, None, None), (0, 1, "user", "a  b"), (0, 1, "user", "a  b"), (0, 1, "bot", ""), (20, 5, "user", "w " * 50000), (21, 5, "user", "w " * 50000), (40, None, "", ""), (41, 2, "é", "ü ß"), (None, 1, "user", "lost"), (7, 1, "user", "no base"), (-5, 1, "user", "below"), (-5, 2, "user", "nought")])


def test_long_and_copied_conversations_are_cut_into_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PIECE", 8)
    rows = [(3, t, "user", f"turn {t}") for t in range(150)] + [(c, t, "user", f"turn {t}") for c in range(1000, 1100) for t in range(9)]
    check(spark, rows)


def test_a_conversation_of_equal_rows_spans_ranges(spark):
    check(spark, [(9, None, "user", "same")] * 300 + [(10, 1, "user", "other")])


def test_empty_table(spark):
    assert got(trie.conversation_trie(table(spark, []))) == []


def test_a_lone_conversation_without_rebuilt_turns_ends_at_the_root(spark):
    c = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    assert got(trie.conversation_trie(table(spark, [(c, 1, "user", "gone")]))) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("fan", [(), (4,), (16, 4)])
def test_merge_rounds_agree(spark, fan):
    from pyspark.sql import functions as F

    x = spark.range(2000, numPartitions=8).select((F.col("id") % 7).alias("depth"), F.lit(0).alias("k1"), (F.col("id") % 3).alias("k2"), "id")
    rows = trie.merge(x, [F.count(F.lit(1)).alias("n"), F.min("id").alias("m")], [F.sum("n").alias("n"), F.min("m").alias("m")], fan).collect()
    assert len(rows) == 21 and sum(r.n for r in rows) == 2000 and {r.m for r in rows} == set(range(21))
