"""Secret scans: candidate strings found by pattern, false positives removed by a random forest."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import discard, stage

#: Runs of key characters with their padding, and what stands before an assigned value.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{6,}={0,2}")
ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|key|auth|bearer|credential|private)[\w-]*[\"']?\s*[=:]\s*[\"']?$|://[^\s/:@]*:$")
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "private")
HARMLESS = ("sha256", "sha1", "md5", "checksum", "commit", "uuid", "id", "order", "card", "account", "phone", "version", "example", "serial", "digest")
PATHS = ("test", "example", "doc", "sample", "config", "env", "prod", "settings")


def is_candidate(run: str, before: str) -> bool:
    """Runs of 12 characters or more with a digit, of 20 or more with both cases, and whatever is assigned to a key word or stands as a URL's password."""
    if len(run) >= 12 and (any(c.isdigit() for c in run) or len(run) >= 20 and run != run.lower() and run[1:] != run[1:].lower()):
        return True
    return ASSIGNED.search(before) is not None


def kinds(s: str) -> list[int]:
    return [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in s]


def features(candidate: str, before: str, after: str, path: str, dictionary: frozenset[str], pairs: dict[str, float]) -> list[float]:
    """Length, character transitions, dictionary coverage, neighbouring words and path of a candidate."""
    n, k, count = len(candidate), kinds(candidate), Counter(candidate)
    low = candidate.lower()
    turns = sum(a != b for a, b in zip(k, k[1:], strict=False)) / max(1, n - 1)
    shape = [k.count(i) / n for i in range(4)]
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    letters = [low[i : i + 2] for i in range(n - 1) if low[i : i + 2].isalpha()]
    likely = sum(pairs.get(p, -9.0) for p in letters) / len(letters) if letters else -9.0
    covered, i = 0, 0
    while i < n:
        size = next((m for m in range(min(12, n - i), 3, -1) if low[i : i + m] in dictionary), 0)
        covered += size
        i += max(1, size)
    words = re.findall(r"[a-z0-9_]+", before.lower())[-3:]
    last = before.rstrip()[-1:] if before else ""
    return [
        float(n), turns, *shape, entropy, likely, covered / n, float(bool(re.fullmatch(r"[0-9a-f]+", candidate))), float(n in (32, 40, 64)), float(candidate.isdigit()),
        float(any(w in KEYWORDS for w in words)), float(any(w in HARMLESS for w in words)), float(last in "=:"), float(before[-1:] in "\"'" and before != ""),
        float(candidate.startswith(("AKIA", "ASIA", "ghp_", "sk_live_", "xox", "glpat-"))), float(any(w in after.lower() for w in HARMLESS)),
        float(after[:1] == "@"), float(before[-1:] in (".", "@")), float(ASSIGNED.search(before) is not None), min(n, 512) / 512,
        float(any(p in path.lower() for p in PATHS[:4])), float(any(p in path.lower() for p in PATHS[4:])),
    ]


def dictionary_of(docs: DataFrame, text_col: str, size: int = 5000) -> tuple[frozenset[str], dict[str, float]]:
    """The `size` commonest lower-case words of four letters or more and the log probabilities of letter pairs.

    Both are counted over all documents; only the dictionary and one row a pair come to the driver.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]{2,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = stage(words, "secret-words")
    top = [r.w for r in words.where(F.length("w") >= 4).orderBy(F.desc("n"), "w").limit(size).collect()]
    pair = words.select("n", "w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i")).groupBy(F.substring("w", F.col("i"), F.lit(2)).alias("p")).agg(F.sum("n").alias("n"))
    pairs = {r.p: r.n for r in pair.collect()}
    total = sum(pairs.values())
    discard(words)
    return frozenset(top), {p: math.log2(c / total) for p, c in pairs.items()}


def labelled_findings(rows: int = 3000, seed: int = 3) -> pd.DataFrame:
    """Findings (candidate, before, after, path, label) made by rule for where no reviewed findings are at hand.

    Keys of known shapes and random values assigned to secret-like names are secrets (1). Card, order and phone
    numbers, digests and ids named as such, versioned names, words with a number, and placeholders are not (0).
    """
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hex_, up, mixed, low = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "etaoinshrdlu"
    word = lambda: pick(low, rng.randint(2, 9))
    out = []
    for _ in range(rows):
        label, ctx = rng.random() < 0.5, " ".join(word() for _ in range(3)) + " "
        after, path = " " + word(), rng.choice(["src", "web/page", "config/app.env", "prod/settings", "test/fixture", "doc/example"])
        if label:
            name, eq = rng.choice(KEYWORDS), rng.choice(["=", ": ", ' = "', ' = ', "='"])
            body = rng.choice([lambda: pick(hex_, rng.choice([18, 24, 32, 40, 64])), lambda: pick(mixed, rng.randint(16, 48)), lambda: pick(mixed, rng.randint(8, 14)), lambda: pick(mixed[:52], rng.randint(20, 40)), lambda: pick(mixed + "+/", rng.randint(130, 400)) + rng.choice(["", "=", "=="]), lambda: "AKIA" + pick(up, 16), lambda: "ghp_" + pick(mixed, 36), lambda: "sk_live_" + pick(mixed, 24)])()
            known = body.startswith(("AKIA", "ghp_", "sk_live_"))
            before = ctx if known and rng.random() < 0.7 else ctx + name + eq
            if not known and rng.random() < 0.15:
                before, after = ctx + "postgres://" + word() + ":", "@" + word() + ".example"
        else:
            case = rng.randrange(9)
            name = rng.choice(HARMLESS)
            body = [lambda: pick("0123456789", rng.choice([12, 13, 15, 16, 19])), lambda: pick(hex_, rng.choice([32, 40, 64])), lambda: "-".join(pick(hex_, k) for k in (8, 4, 4, 4, 12)), lambda: f"{word()}-{word()}{word()}-{rng.randint(1, 99)}",
                    lambda: f"{word()}{word()}{word()}{rng.randint(1, 9999)}", lambda: rng.choice(["xxxxxxxxxxxx1234", "1234567890123456", "your_api_key_here1", "0000000000000000"]), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{rng.randint(10, 99)}",
                    lambda: f"{word()}{word()}{rng.randint(1970, 2020)}", lambda: f"{word()}{rng.choice(['_', '-', ''])}{word()}{word()}"][case]()
            before = ctx + (name + rng.choice(["=", ": ", " "]) if case in (1, 2) or rng.random() < 0.3 else "")
            if case == 5:
                before = ctx + rng.choice(KEYWORDS) + "="
            if case == 7:  # the name of an address, a part of a host
                before, after = rng.choice([(ctx, "@" + word() + ".example"), (ctx + word() + "@" + word() + ".", ".example")])
            if case == 8:  # a plain word after a key word
                before = ctx + rng.choice(KEYWORDS) + rng.choice([": ", " : ", "="])
        if RUN.fullmatch(body) and is_candidate(body, before):
            out.append((body, before, after, path, int(label)))
    return pd.DataFrame(out, columns=["candidate", "before", "after", "path", "label"])


def train(spark: SparkSession, findings: pd.DataFrame, dictionary: frozenset[str], pairs: dict[str, float], trees: int = 40, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel:
    """A random forest over the features of labelled findings (a bounded table: candidate, before, after, path, label)."""
    x = [features(r.candidate, r.before, r.after, r.path, dictionary, pairs) for r in findings.itertuples()]
    data = spark.createDataFrame(pd.DataFrame({"x": x, "label": findings["label"].astype(float)}), "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data)


def candidates(docs: DataFrame, dictionary: frozenset[str], pairs: dict[str, float], id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row a candidate of every whole text: doc_id, start, length (characters), sha256, x (features)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, text, path in zip(f["id"], f["text"], f["path"], strict=True):
                for m in RUN.finditer(text):
                    s, e = m.span()
                    before = text[max(0, s - 40) : s]
                    if is_candidate(m[0], before):
                        rows.append((doc, s, e - s, m[0], features(m[0], before, text[e : e + 24], path, dictionary, pairs)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "candidate", "x"])

    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path")).where("text is not null")
    out = some.mapInPandas(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, start int, length int, candidate string, x array<double>")
    return out.withColumn("sha256", F.sha2("candidate", 256)).drop("candidate")


def scan(docs: DataFrame, findings: pd.DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Every candidate with the forest's probability that it is a secret: doc_id, start, length, sha256, p_secret, is_secret.

    findings: reviewed findings to learn from (labelled_findings() if None). The candidate itself is never returned,
    only its place and digest. Null and empty texts have no candidates; a null path counts as empty; repeated rows
    give repeated findings; an empty table gives an empty result; other columns are ignored.
    """
    dictionary, pairs = dictionary_of(docs, text_col)
    model = train(docs.sparkSession, labelled_findings() if findings is None else findings, dictionary, pairs)
    found = candidates(docs, dictionary, pairs, id_col, text_col, path_col).withColumn("features", array_to_vector("x"))
    p = F.round(vector_to_array("probability")[1], 6)
    return model.transform(found).select("doc_id", "start", "length", "sha256", p.alias("p_secret"), (p >= threshold).alias("is_secret"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
