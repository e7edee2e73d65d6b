"""The index in a folder: the same answers as a scan of the texts, kept up by hash."""

import random

import pytest
from pyspark.sql import functions as F

from lakelens.functions.stem import fold, stem
from lakelens.operators import search
from lakelens.operators.textindex import TextIndex

QUERIES = ["alpha", "alpha beta", "alpha OR gamma", "(alpha AND beta) NOT delta", "NEAR(alpha gamma, 2)", "del*", '"beta gamma" OR epsilon', "nothing"]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, t string, term string, length int")


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["Alpha", "beta", "gamma,", "delta", "epsilon-beta", "x"]) for _ in range(rng.randrange(12))), "c", 1) for i in range(n)] + [(n, None, "c", 1), (None, "alpha", "c", 1)]


def scores(df):
    return {r.key: round(r.score, 9) for r in df.collect()}


@pytest.mark.parametrize("word, want", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
    ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
    ("valenci", "valenc"), ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"), ("decisiveness", "decis"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"),
    ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("as", "as"), ("ünder", "ünder"),
])
def test_stems_of_the_published_rules(word, want):
    assert stem(word) == want


def test_fold():
    assert fold("éàü") == "eau" and fold("ascii") == "ascii" and fold("ß") == "ß"


def test_search_of_the_index_equals_search_of_the_texts(spark, tmp_path):
    docs = table(spark, texts(200))
    index = TextIndex.build(docs, "id", "t", str(tmp_path / "i"), buckets=4, stemming=False)
    for q in QUERIES:
        assert scores(index.search(q)) == scores(search.search(docs.where("id is not null"), "id", "t", q)), q
    assert {(r.term, r.docs, r.occurrences) for r in index.vocabulary().collect()} == {(r.term, r.docs, r.occurrences) for r in search.vocabulary(docs.where("id is not null"), "id", "t").collect()}


def test_refresh_adds_changes_and_removes(spark, tmp_path):
    rows = texts(60)
    root = str(tmp_path / "i")
    index = TextIndex.build(table(spark, rows), "id", "t", root, buckets=3, stemming=False)
    assert index.refresh(table(spark, rows), "id", "t") == {"added": 0, "changed": 0, "removed": 0} and index.at.gen == 1
    new = [r for r in rows if r[0] is None or r[0] % 5] + [(500, "alpha beta beta", "c", 1)]
    new = [(i, "gamma alpha" if i and i % 7 == 1 else t, *rest) for i, t, *rest in new]
    before = {r[0]: r[1] for r in rows}
    changed = sum(i in before and before[i] != t for i, t, *_ in new if i is not None)
    assert index.refresh(table(spark, new), "id", "t") == {"added": 1, "changed": changed, "removed": 13}
    scan = table(spark, new).where("id is not null")
    for index in (index, TextIndex(spark, root)):
        for q in QUERIES:
            assert scores(index.search(q)) == scores(search.search(scan, "id", "t", q)), q
    index.refresh(table(spark, rows), "id", "t")  # what was removed comes back
    index.compact()
    index = TextIndex(spark, root)
    assert index.at.base == index.at.gen == 4
    for q in QUERIES:
        assert scores(index.search(q)) == scores(search.search(table(spark, rows).where("id is not null"), "id", "t", q)), q


def test_words_are_folded_and_stemmed_on_both_sides(spark, tmp_path):
    docs = table(spark, [(1, "The café was running late", "c", 1), (2, "runs and cafes", "c", 1), (3, "a runner", "c", 1)])
    index = TextIndex.build(docs, "id", "t", str(tmp_path / "i"))
    assert set(scores(index.search("run"))) == set(scores(index.search("Running"))) == {1, 2}
    assert set(scores(index.search("CAFÉ"))) == {1, 2}
    assert set(scores(index.search("was run late"))) == {1}


def test_only_the_terms_postings_are_read(spark, tmp_path):
    root = tmp_path / "i"
    index = TextIndex.build(table(spark, texts(50)), "id", "t", str(root), buckets=16, stemming=False)
    x = index.postings(["alpha"])
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "EqualTo(term,alpha)" in plan
    assert all(str(root) in f and "/postings/" in f for f in index.search("alpha beta").inputFiles())


def test_a_term_has_one_row_for_many_texts_and_loses_none(spark, tmp_path):
    rows = texts(300)
    index = TextIndex.build(table(spark, rows).coalesce(1), "id", "t", str(tmp_path / "i"), buckets=4, stemming=False)
    written = spark.read.parquet(str(tmp_path / "i" / "postings")).where("bucket >= 0")
    assert written.count() == 6 and written.where("term = 'alpha'").first().docs > 100  # one row a term, not one a posting
    want = {(r.term, r.key): (r.tf, list(r.positions)) for r in search.postings(table(spark, rows).where("id is not null"), "id", "t").collect()}
    assert {(r.term, r.key): (r.tf, list(r.positions)) for r in index._postings().collect()} == want
    index.refresh(table(spark, rows[:250]), "id", "t")
    index.compact()
    assert {(r.term, r.key): (r.tf, list(r.positions)) for r in index._postings().collect()} == {k: v for k, v in want.items() if k[1] < 250}


def test_close_terms_when_nothing_matches(spark, tmp_path):
    docs = table(spark, [(1, "the quick fox", "c", 1), (2, "quickly gone", "c", 1), (3, "slow", "c", 1)])
    index = TextIndex.build(docs, "id", "t", str(tmp_path / "i"), stemming=False)
    assert set(scores(index.search_or_close("quikc"))) == {1, 2}  # quick* and quickly*
    assert set(scores(index.search_or_close("slow"))) == {3} and scores(index.search_or_close("zzzz")) == {}


def test_results_are_remembered_until_the_index_changes(spark, tmp_path):
    docs = table(spark, texts(30))
    index = TextIndex.build(docs, "id", "t", str(tmp_path / "i"), stemming=False)
    first = scores(index.remembered("alpha", k1=1.0))
    kept = next((tmp_path / "i" / "results").iterdir())
    stamp = (kept / "gen=1" / "_SUCCESS").stat().st_mtime_ns
    assert scores(index.remembered("alpha", k1=1.0)) == first == scores(index.search("alpha", k1=1.0)) and (kept / "gen=1" / "_SUCCESS").stat().st_mtime_ns == stamp
    index.refresh(docs.where("id > 10"), "id", "t")
    assert scores(index.remembered("alpha", k1=1.0)) == scores(index.search("alpha", k1=1.0)) != first
    assert [p.name for p in kept.iterdir() if p.is_dir()] == ["gen=2"]


def test_empty_table(spark, tmp_path):
    index = TextIndex.build(table(spark, []), "id", "t", str(tmp_path / "i"))
    assert scores(index.search("alpha")) == {} and index.documents().isEmpty()
    assert index.refresh(table(spark, [(1, "alpha", "c", 1)]), "id", "t")["added"] == 1 and set(scores(index.search("alpha"))) == {1}


def test_snippets_merge_and_stop(spark):
    words = [f"w{i}" for i in range(100)]
    for i in (0, 5, 30, 60, 90):
        words[i] = f"The{i}"
    got = spark.createDataFrame([(" ".join(words),), ("none",), (None,)], "t string").select(search.snippet("t", ["the"], 3).alias("s")).collect()
    assert got[0].s == " ... ".join([" ".join(words[0:9]), " ".join(words[27:34]), " ".join(words[57:64])]) and got[1].s is None and got[2].s is None
    assert spark.range(1).select(search.snippet(F.lit("a b c"), ["b"], 0).alias("s")).first().s == "b"
