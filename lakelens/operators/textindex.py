"""A search index that lives in a folder: positional postings by term, documents by hash, results by query.

Each refresh that finds changes writes one generation: the documents that are new, changed or gone, and the postings of
the new and changed ones. A row of `commits`, written last, makes the generation count; what a failed refresh left
behind is written over by the next. A row of postings holds a term's places in a run of documents, as flat arrays: few
long rows are shuffled and sorted, not one for every word of every text. A search reads only the postings of its terms:
folders are pruned by the terms' buckets, row groups by the sorted terms. One writer at a time; readers keep the
generation they opened.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lakelens.functions.stem import fold, stem
from lakelens.operators.search import Node, close_terms, leaves, matches, occurrences, parse
from lakelens.sources.shared import exists, listing, remove

WORD = re.compile(r"[^\W_]+")
COMMIT = "gen long, base long, docs long, total_length long, buckets int, folding boolean, stemming boolean, key_type string"
#: Words of the texts that one row of postings spans at most, but for a single longer text.
RUN = 1_000_000
#: Parts in which a bucket's rows are written, so that no task holds all rows of a frequent term.
PARTS = 16
#: The bucket whose rows list every document with its length.
LENGTHS = -1


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def rows_of(kind: str) -> str:
    """Schema of the rows of postings: document i of a row has the places from ends[i - 1] to ends[i]."""
    return f"term string, docs int, occurrences long, keys array<{kind}>, lengths array<int>, ends array<int>, positions array<int>"


def runs_of(names: pa.Array, code: np.ndarray, keys: pa.Array, lengths: np.ndarray, sizes: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """Rows of postings made of postings that are in order of terms: number of the name, key, length, number of places; all places one after another."""
    start = np.flatnonzero(np.diff(code, prepend=-1))
    end = np.append(start[1:], len(code))
    places = np.concatenate([[0], np.cumsum(sizes)])
    ends = places[1:] - np.repeat(places[start], end - start)
    split = lambda at, values: pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()), values)
    ints = lambda v: pa.array(v, pa.int32())
    columns = [names.take(pa.array(code[start])), ints(end - start), pa.array(places[end] - places[start], pa.int64()), split(start, keys), split(start, ints(lengths)), split(start, ints(ends)), split(places[start], ints(positions))]
    return pa.RecordBatch.from_arrays(columns, ["term", "docs", "occurrences", "keys", "lengths", "ends", "positions"])


class TextIndex:
    """The index in a folder as of its last generation, which must exist (see `build`)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.at = spark.read.schema(COMMIT).parquet(f"{self.root}/commits").orderBy(F.desc("gen")).first()
        if self.at is None:
            raise FileNotFoundError(f"{root} holds no index")

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, root: str, buckets: int = 64, folding: bool = True, stemming: bool = True) -> TextIndex:
        """Open the index of the folder, made of docs if there is none yet."""
        spark = docs.sparkSession
        if not any(n.startswith("part-") for n in listing(spark, f"{root}/commits")):
            first = (0, 1, 0, 0, buckets, folding, stemming, docs.schema[key].dataType.simpleString())
            spark.createDataFrame([first], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits")
            cls(spark, root).refresh(docs, key, text)
        return cls(spark, root)

    # Reading

    def _generations(self, kind: str, schema: str) -> DataFrame:
        gens = F.col("gen").between(self.at.base, self.at.gen)
        if not exists(self.spark, f"{self.root}/{kind}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}").where(gens)

    def documents(self) -> DataFrame:
        """(key, hash, length) of the documents that are in the index; length is null where the text is."""
        last = self._history().groupBy("key").agg(F.max_by(F.struct("hash", "length", "gone"), "gen").alias("d"))
        return last.where("not d.gone").select("key", "d.hash", "d.length")

    def _history(self) -> DataFrame:
        return self._generations("documents", f"key {self.at.key_type}, hash string, length int, gone boolean, gen long")

    def _rows(self) -> DataFrame:
        return self._generations("postings", f"{rows_of(self.at.key_type)}, gen long, bucket int").where(F.col("bucket") != LENGTHS)

    def _postings(self) -> DataFrame:
        """(term, key, length, tf, positions, gen, bucket) that count, of all terms; filters on bucket and term reach the files."""
        before = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
        one = lambda k, i: F.struct(
            k.alias("key"), F.get("lengths", i).alias("length"), (F.get("ends", i) - before(i)).alias("tf"), F.slice("positions", before(i) + 1, F.get("ends", i) - before(i)).alias("positions")
        )
        x = self._rows().select("term", "gen", "bucket", F.inline(F.transform("keys", one)))
        if self.at.gen == self.at.base:
            return x
        # Generations after the base replace or remove keys of earlier ones; those few are left out.
        later = self._history().where(F.col("gen") > self.at.base).groupBy("key").agg(F.max("gen").alias("last"))
        return x.join(later, "key", "left").where(F.col("last").isNull() | (F.col("last") == F.col("gen"))).drop("last")

    def postings(self, terms: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
        """The postings of some terms and of all terms that start with one of the prefixes."""
        x, wanted = self._postings(), F.lit(False)
        if terms:
            buckets = sorted({self._bucket(t) for t in terms})
            wanted = F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)
        for p in prefixes:
            wanted = wanted | F.col("term").startswith(p)
        return x.where(wanted).select("term", "key", "length", "tf", "positions")

    def _bucket(self, term: str) -> int:
        return zlib.crc32(term.encode()) % self.at.buckets

    def vocabulary(self) -> DataFrame:
        """(term, docs, occurrences)."""
        if self.at.gen == self.at.base:
            return self._rows().groupBy("term").agg(F.sum(F.col("docs").cast("long")).alias("docs"), F.sum("occurrences").alias("occurrences"))
        return self._postings().groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))

    def form(self, word: str) -> str:
        """A query's word as the index holds it."""
        word = fold(word.lower()) if self.at.folding else word.lower()
        return stem(word) if self.at.stemming else word

    def _tree(self, n: Node) -> Node:
        if n.kind == "prefix":  # prefixes are cut from whole words, so they are not stemmed
            return replace(n, parts=tuple(fold(w) if self.at.folding else w for w in n.parts))
        return replace(n, parts=tuple(map(self.form, n.parts) if n.kind in ("phrase", "near") else map(self._tree, n.parts)))

    def search(self, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, score) of the documents that match, by BM25 over the query's phrases; a phrase is one unit.

        Number and mean length of the documents come from the last commit, the units' frequencies from the postings.
        """
        return self._ranked(self._tree(parse(query)), k1, b)

    def _ranked(self, tree: Node, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        units = list(dict.fromkeys(leaves(tree)))
        words = sorted({w for u in units if u.kind != "prefix" for w in u.parts})
        hits = self.postings(words, [u.parts[0] for u in units if u.kind == "prefix"])
        x = hits.groupBy("key").agg(F.first("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        x = x.select("key", "length", *[occurrences(u, F.col("at")).alias(f"u{i}") for i, u in enumerate(units)])
        frequency = x.agg(*[F.count_if(F.col(f"u{i}") > 0).alias(f"u{i}") for i in range(len(units))]).first()
        n, mean = self.at.docs, self.at.total_length / max(self.at.docs, 1)
        score = F.lit(0.0)
        for i in range(len(units)):
            df, tf = frequency[f"u{i}"], F.col(f"u{i}")
            idf = F.greatest(F.lit(1e-6), F.ln(F.lit((n - df + 0.5) / (df + 0.5))))
            score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(float(mean) or 1.0)))
        return x.where(matches(tree, {u: F.col(f"u{i}") for i, u in enumerate(units)})).select("key", score.alias("score"))

    def search_or_close(self, query: str, least: float = 80.0, top: int = 5) -> DataFrame:
        """search(query); if nothing matches, what matches any word that starts with one of the most similar terms."""
        found = self.search(query)
        if not found.isEmpty():
            return found
        word = query.strip().lower()
        terms = close_terms(self.vocabulary(), fold(word) if self.at.folding else word, least, top)
        return self._ranked(Node("or", tuple(Node("prefix", (t,)) for t in terms))) if terms else found

    def remembered(self, query: str, **options: float) -> DataFrame:
        """search(query, **options), kept under the hash of query and options until the index has a later generation."""
        name = hashlib.sha256(json.dumps({"query": query, **options}, sort_keys=True).encode()).hexdigest()
        folder = f"{self.root}/results/{name}"
        if not exists(self.spark, f"{folder}/gen={self.at.gen}/_SUCCESS"):
            stale = [g for g in listing(self.spark, folder) if int(g.removeprefix("gen=")) < self.at.gen]
            self.search(query, **options).write.mode("overwrite").parquet(f"{folder}/gen={self.at.gen}")
            for g in stale:
                remove(self.spark, f"{folder}/{g}")
        return self.spark.read.schema(f"key {self.at.key_type}, score double").parquet(f"{folder}/gen={self.at.gen}")

    # Writing

    def refresh(self, docs: DataFrame, key: str, text: str) -> dict[str, int]:
        """Bring the index up to docs: documents whose hash is new are indexed, those that are gone are left out.

        Keys must be unique; rows with a null key are not indexed; a null text matches nothing and does not count in
        the mean length. Returns how many were added, changed and removed; no change writes nothing.
        """
        now = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.md5(text), F.lit("")).alias("hash"))
        gen, folding, stemming, kind = self.at.gen + 1, self.at.folding, self.at.stemming, self.at.key_type

        class Forms(dict):
            """Numbers of words by their forms; filled as words come."""

            def __init__(self):
                self.terms: dict[str, int] = {}

            def __missing__(self, word: str) -> int:
                w = fold(word) if folding else word
                n = self[word] = self.terms.setdefault(stem(w) if stemming else w, len(self.terms))
                return n

        def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of postings of runs of texts, and a row without term that gives the texts' lengths."""
            keys: list = []
            sizes, codes, forms = array("i"), array("i"), Forms()

            def run(like: pa.DataType) -> Iterator[pa.RecordBatch]:
                length, code = np.array(sizes, "int64"), np.array(codes, "int32")
                doc = np.repeat(np.arange(len(length)), length)
                place = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
                order = np.argsort(code, kind="stable")  # within a term, by document and place
                code, doc, place = code[order], doc[order], place[order]
                first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
                names, all_keys = pa.array(list(forms.terms), pa.string()), pa.array(keys, like)
                yield runs_of(names, code[first], all_keys.take(pa.array(doc[first])), length[doc[first]], np.diff(np.append(first, len(code))), place)
                yield runs_of(pa.array([None], pa.string()), np.zeros(len(length), "int32"), all_keys, length, np.zeros(len(length), "int64"), np.zeros(0, "int32"))

            for batch in batches:
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = WORD.findall(t.lower())
                    if keys and len(codes) + len(words) > RUN:
                        yield from run(batch.column(0).type)
                        keys.clear()
                        sizes, codes, forms = array("i"), array("i"), Forms()
                    keys.append(k)
                    sizes.append(len(words))
                    codes.extend(map(forms.__getitem__, words))
                like = batch.column(0).type
            if keys:
                yield from run(like)

        if self.at.gen:
            old = self.documents().select("key", "hash")
            changes = now.select("key", "hash").join(old.withColumnRenamed("hash", "old"), "key", "full").where(~F.col("hash").eqNullSafe(F.col("old")))
            fresh = now.join(changes.where("hash is not null").select("key"), "key", "left_semi")
        else:  # all documents are new
            changes, fresh = now.select("key", "hash", F.lit(None).cast("string").alias("old")), now
        counts = changes.agg(*[F.count_if(F.expr(c)) for c in ("old is null", "old is not null and hash is not null", "hash is null")]).first()
        done = dict(zip(("added", "changed", "removed"), counts, strict=True))
        if not any(counts):
            return done
        words = fresh.where("text is not null").select("key", "text").mapInArrow(spelt, rows_of(kind))
        self._write(words.withColumn("bucket", F.when(F.col("term").isNull(), LENGTHS).otherwise(bucket_of(F.col("term"), self.at.buckets))), gen)
        length = self.spark.read.schema(f"{rows_of(kind)}, bucket int").parquet(f"{self.root}/postings/gen={gen}").where(F.col("bucket") == LENGTHS)
        length = length.select(F.inline(F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.get("lengths", i).alias("length")))))
        changes.select("key", F.coalesce("hash", F.lit("")).alias("hash"), F.col("hash").isNull().alias("gone")).join(length, "key", "left").select("key", "hash", "length", "gone").write.mode("overwrite").parquet(f"{self.root}/documents/gen={gen}")
        self._commit(gen, max(self.at.base, 1))
        return done

    def _write(self, rows: DataFrame, gen: int) -> None:
        """The generation's rows of postings, each bucket in at most PARTS files, in order of terms."""
        part = F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(PARTS))
        rows.repartition("bucket", part).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/postings/gen={gen}")

    def _commit(self, gen: int, base: int) -> None:
        to = self.at
        self.at = Row(**{**to.asDict(), "gen": gen, "base": base})  # the documents of the new generation are counted
        n, total = self.documents().agg(F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first()
        row = {**self.at.asDict(), "docs": n, "total_length": total}
        self.spark.createDataFrame([tuple(row.values())], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        self.at = Row(**row)

    def compact(self) -> None:
        """Write what counts as one generation of its own and remove those before."""
        gen, before = self.at.gen + 1, (self.at.base, self.at.gen)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                terms = b.column(0).dictionary_encode()
                yield runs_of(terms.dictionary, terms.indices.to_numpy(), b.column(1), *[c.to_numpy(zero_copy_only=False) for c in (b.column(2), b.column(3), b.column(4).flatten())])

        x = self._postings().select("term", "key", "length", "tf", "positions").repartitionByRange("term", "key").sortWithinPartitions("term", "key")
        x = x.mapInArrow(packed, rows_of(self.at.key_type))
        self._write(x.withColumn("bucket", bucket_of(F.col("term"), self.at.buckets)), gen)
        self.documents().select("key", "hash", "length", F.lit(False).alias("gone")).write.mode("overwrite").parquet(f"{self.root}/documents/gen={gen}")
        self._commit(gen, gen)
        for g in range(before[0], before[1] + 1):
            for kind in ("postings", "documents"):
                remove(self.spark, f"{self.root}/{kind}/gen={g}")
