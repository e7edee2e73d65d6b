"""Cases worked by hand of rules that are easily misread."""

from pyspark.sql import functions as F

from lakelens.operators import filing, joins, records


def test_duplicates_share_name_and_size_or_content(spark):
    rows = [(1, "a.txt", 3, "h1"), (2, "A.TXT", 3, "h2"), (3, "b.txt", 9, "h2"), (4, "c.txt", 9, "h3"), (5, "d.txt", 1, None), (6, "e.txt", 1, None), (7, "f.txt", None, "h4"), (8, "F.txt", None, None), (9, "g", 2, "h5")]
    got = filing.duplicate_files(spark.createDataFrame(rows, "id int, name string, size int, digest string"), "name", "size", "digest")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 7, 8] and got.columns == ["id", "name", "size", "digest"]


def test_blank_metadata_falls_back_to_the_text(spark):
    x = spark.createDataFrame([("Kunde: A, B\nPatch: P1", {"Kunde": ""}), ("Kunde: AB", {"kunde": " . ", "Art": "x"}), ("Kunde: AB", {"KUNDE": "C, D"}), ("nothing", None)], "t string, m map<string,string>")
    assert [r.v for r in x.select(records.virtual_tags("t", F.col("m")).alias("v")).collect()] == [["patch: p1"], ["kunde: ab"], ["kunde: c d"], []]


def test_verification_compares_only_what_the_manifest_gives(spark):
    m = spark.createDataFrame([("a", "1"), ("b", None), ("c", ""), ("d", "4"), ("e", "5")], "p string, d string")
    have = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "x")], "p string, d string")
    found = lambda full: {(r.p, r.problem) for r in filing.verification(m, have, "p", "d", full).collect()}
    assert found(True) == {("d", "mismatch"), ("e", "missing")} and found(False) == {("d", "mismatch")}


def test_brackets_of_a_path_are_no_stamp(spark):
    lines = spark.createDataFrame([("docs/a[1].pdf",), ("[2024-01-02T03:04:05] x/2024/05/acme/b.PDF",), ("  ",), ("[info] y\\\\z",)], "line string")
    got = [(r.path, r.file, r.extension, r.year, r.customer, str(r.ts)) for r in records.log_entries(lines, "line").collect()]
    assert got == [("docs/a[1].pdf", "a[1].pdf", "pdf", None, None, "None"), ("x/2024/05/acme/b.PDF", "b.PDF", "pdf", "2024", "acme", "2024-01-02 03:04:05"), ("y/z", "z", "", None, None, "None")]


def test_files_of_a_patient_that_no_rule_takes(spark):
    x = spark.createDataFrame([("a/x.zip", "p1"), ("a/x.md", "p1"), ("a/x.zip", None), ("lab.zip", "p1")], "path string, who string")
    assert [r.f for r in x.select(filing.health_folder("path", "who").alias("f")).collect()] == ["Health/Patients/p1/unsorted", "Health/Patients/p1/Archive", "Health/Archive", "Health/Patients/p1/Lab"]


def test_references_by_name(spark):
    cols = [("orders", "user_id"), ("orders", "path"), ("User", "id"), ("files", "Path"), ("User", "_id"), ("orders", "shop_ID")]
    r = joins.relations(spark.createDataFrame(cols, "table string, column string"))
    got = {(x.table, x.column, x.target, x.confidence) for x in r.collect()}
    medium = {("orders", "path", t, "medium") for t in ("file_index", "file_metadata", "file_tags", "files")} | {("files", "Path", t, "medium") for t in ("file_index", "file_metadata", "file_tags")}
    assert got == {("orders", "user_id", "User", "high"), ("orders", "shop_ID", None, "low")} | medium
    assert {(x.table, tuple(x.targets)) for x in joins.relation_graph(r).collect()} == {("orders", ("User", "file_index", "file_metadata", "file_tags", "files")), ("files", ("file_index", "file_metadata", "file_tags"))}
