"""Observers: plug-ins that turn files into states and two states into events, run as a graph of DataFrames.

An observer says which files concern it, extracts one state a file and compares it with the state kept from the run
before. Those that need others run after them and are given their states and events. Every observer works on all files
of a run at once.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.sources.shared import exists, listing, remove, staged

EVENT = "path string, event string, field string, old string, new string"


@dataclass(frozen=True)
class Output:
    """What an observer made in a run: a state a file, and its events."""

    states: DataFrame
    events: DataFrame


class Observer(ABC):
    """name: unique; needs: the names of observers whose outputs it takes."""

    name: str
    needs: tuple[str, ...] = ()

    def applies(self) -> Column:
        """A condition on the files' rows."""
        return F.lit(True)

    @abstractmethod
    def extract(self, files: DataFrame, given: Mapping[str, Output]) -> DataFrame:
        """One row a file: path, and the columns of the state."""

    def compare(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Events (path, event, field, old, new) from two tables of states: created, deleted, and every column that differs."""
        names = [c for c in new.columns if c != "path"]
        text = lambda c, t: F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string")
        kind = dict(new.dtypes)
        side = lambda d, p: d.select("path", F.lit(True).alias(f"{p}has"), *[text(c, kind[c]).alias(f"{p}{c}") for c in names])
        both = side(old, "o_").join(side(new, "n_"), "path", "full")
        none = F.lit(None).cast("string")
        row = lambda event, f, a, b: F.struct(F.lit(event).alias("event"), F.lit(f).cast("string").alias("field"), a.alias("old"), b.alias("new"))
        changed = F.array_compact(F.array(*[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), row("CHANGED", c, F.col(f"o_{c}"), F.col(f"n_{c}"))) for c in names]))
        events = F.when(F.col("o_has").isNull(), F.array(row("CREATED", None, none, none))).when(F.col("n_has").isNull(), F.array(row("DELETED", None, none, none))).otherwise(changed)
        return both.select("path", F.inline(events))


@dataclass
class Registry:
    """Observers by name, each on or off."""

    observers: dict[str, Observer] = field(default_factory=dict)
    off: set[str] = field(default_factory=set)

    def add(self, *observers: Observer) -> Registry:
        for o in observers:
            if o.name in self.observers:
                raise ValueError(f"there is an observer {o.name} already")
            self.observers[o.name] = o
        return self

    def enable(self, name: str, on: bool = True) -> None:
        if name not in self.observers:
            raise KeyError(name)
        (self.off.discard if on else self.off.add)(name)

    def in_order(self) -> list[Observer]:
        """The enabled observers, those that are needed before those that need them.

        An observer whose needs are not all enabled is left out, and so are those that need it; a circle is an error.
        """
        on = {n: o for n, o in self.observers.items() if n not in self.off}
        while lacking := [n for n, o in on.items() if not set(o.needs) <= on.keys()]:
            for n in lacking:
                del on[n]
        out: list[Observer] = []
        while len(out) < len(on):
            done = {o.name for o in out}
            ready = [o for n, o in on.items() if n not in done and set(o.needs) <= done]
            if not ready:
                raise ValueError(f"observers need one another: {sorted(set(on) - done)}")
            out += ready
        return out


class SnapshotStore:
    """States by observer and run in a folder; a run counts once its marker is written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def runs(self) -> list[int]:
        return sorted(int(n.removeprefix("run=")) for n in listing(self.spark, f"{self.root}/done"))

    def last(self, name: str, before: int | None = None) -> DataFrame | None:
        """The states of the last run that kept any, before a run if one is given."""
        for run in reversed(self.runs()):
            if (before is None or run < before) and exists(self.spark, f"{self.root}/states/{name}/run={run}/_SUCCESS"):
                return self.spark.read.parquet(f"{self.root}/states/{name}/run={run}")
        return None

    def keep(self, name: str, run: int, states: DataFrame) -> DataFrame:
        path = f"{self.root}/states/{name}/run={run}"
        states.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(states.schema).parquet(path)

    def finish(self, run: int, keep_runs: int = 10) -> None:
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/done/run={run}")
        for old in self.runs()[:-keep_runs]:
            remove(self.spark, f"{self.root}/done/run={old}")
            for name in listing(self.spark, f"{self.root}/states"):
                remove(self.spark, f"{self.root}/states/{name}/run={old}")


def observe(files: DataFrame, registry: Registry, store: SnapshotStore, run: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events (observer, path, event, field, old, new) of a run over all files, and its metrics (observer, files, events).

    The states of the run are kept for the next; a run that is repeated under its number gives the same events. An
    observer's first run has a CREATED event for every file.
    """
    spark = files.sparkSession
    run = (store.runs() or [0])[-1] + 1 if run is None else run
    outputs: dict[str, Output] = {}
    for o in registry.in_order():
        states = store.keep(o.name, run, o.extract(files.where(o.applies()), {n: outputs[n] for n in o.needs}))
        old = store.last(o.name, run)
        events = o.compare(states.where(F.lit(False)) if old is None else old, states).select("path", "event", "field", "old", "new")
        outputs[o.name] = Output(states, staged(events, f"events-{o.name}"))
    store.finish(run)
    every, metrics = spark.createDataFrame([], f"observer string, {EVENT}"), spark.createDataFrame([], "observer string, files long, events long")
    for n, out in outputs.items():
        every = every.unionByName(out.events.select(F.lit(n).alias("observer"), "*"))
        one = out.states.agg(F.count(F.lit(1)).alias("files")).join(out.events.agg(F.count(F.lit(1)).alias("events")), F.lit(True))
        metrics = metrics.unionByName(one.select(F.lit(n).alias("observer"), "files", "events"))
    return every, metrics


class StateObserver(Observer):
    """Digest and size of each file (path, content); an event is CREATED, DELETED, REPLACED (of equal size) or UPDATED."""

    name = "state"

    def extract(self, files: DataFrame, given: Mapping[str, Output]) -> DataFrame:
        return files.select("path", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("size"))

    def compare(self, old: DataFrame, new: DataFrame) -> DataFrame:
        x = old.select("path", F.col("digest").alias("old"), F.col("size").alias("_o"), F.lit(True).alias("_a")).join(new.select("path", F.col("digest").alias("new"), F.col("size").alias("_n"), F.lit(True).alias("_b")), "path", "full")
        event = F.when(F.col("_a").isNull(), "CREATED").when(F.col("_b").isNull(), "DELETED").when(~F.col("old").eqNullSafe(F.col("new")), F.when(F.col("_o") == F.col("_n"), "REPLACED").otherwise("UPDATED"))
        return x.select("path", event.alias("event"), F.lit("digest").alias("field"), "old", "new").where("event is not null")


class FieldObserver(Observer):
    """Named fields of a file's text, each by rules tried in order.

    A rule is a pattern with one group, searched line by line without regard to case, or "toml:key" for the value of a
    line `key = value`, or "meta:key" for an entry of the column `meta` (a map). With many, a field holds all matches,
    sorted and without repeats, joined by "; ".
    """

    name = "fields"

    def __init__(self, rules: Mapping[str, Sequence[str]], many: Sequence[str] = ()):
        self.rules, self.many = rules, set(many)

    def _pattern(self, rule: str) -> str:
        if rule.startswith("toml:"):
            return rf"""(?m)^\s*{rule[5:]}\s*=\s*["']?(.*?)["']?\s*$"""
        return f"(?mi){rule}"

    def extract(self, files: DataFrame, given: Mapping[str, Output]) -> DataFrame:
        def value(name: str) -> Column:
            out = []
            for rule in self.rules[name]:
                if rule.startswith("meta:"):
                    found = F.element_at("meta", rule[5:])
                elif name in self.many:
                    found = F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(self._pattern(rule)), F.lit(1)), lambda v: F.trim(v)))), "; ")
                else:
                    found = F.regexp_extract("content", self._pattern(rule), 1)
                out.append(F.nullif(F.trim(found), F.lit("")))
            return F.coalesce(*out)

        return files.select("path", *[value(n).alias(n) for n in self.rules])


class CsvObserver(Observer):
    """Columns, numbers of rows and columns, and sums of each numeric column of CSV files (path, content).

    Cells are cut at commas outside quotes, rows at line ends. Lines are dealt by themselves, so a long file is not one task's.
    """

    name = "csv"

    def applies(self) -> Column:
        return F.lower("path").endswith(".csv")

    def extract(self, files: DataFrame, given: Mapping[str, Output]) -> DataFrame:
        cells = lambda line: F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.trim(F.regexp_replace(F.trim(c), r'^"|"$', "")))
        lines = F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != "")
        x = files.select("path", F.sha2("content", 256).alias("digest"), lines.alias("lines"))
        x = x.select("path", "digest", F.when(F.size("lines") > 0, cells(F.get("lines", F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("columns"), F.greatest(F.size("lines") - 1, F.lit(0)).cast("long").alias("rows"), "lines")
        values = x.select("path", "columns", F.posexplode("lines").alias("n", "line")).where("n > 0").select("path", "columns", F.posexplode(cells(F.col("line"))).alias("i", "v"))
        values = values.where(F.col("i") < F.size("columns")).select("path", F.get("columns", F.col("i")).alias("column"), F.col("v").try_cast("double").alias("v"))
        sums = values.groupBy("path", "column").agg(F.count("v").alias("n"), F.round(F.sum("v"), 6).alias("sum"), F.min("v").alias("min"), F.max("v").alias("max")).where("n > 0")
        sums = sums.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("column", "n", "sum", "min", "max"))).alias("summary"))
        return x.drop("lines").withColumn("width", F.size("columns").cast("long")).join(sums, "path", "left")

    def compare(self, old: DataFrame, new: DataFrame) -> DataFrame:
        side = lambda d, p: d.select("path", *[F.col(c).alias(f"{p}{c}") for c in ("digest", "columns", "rows", "width", "summary")])
        x = side(old, "o_").join(side(new, "n_"), "path", "full")
        none = F.lit(None).cast("string")
        row = lambda e, f, a, b: F.struct(F.lit(e).alias("event"), f.cast("string").alias("field"), a.cast("string").alias("old"), b.cast("string").alias("new"))
        differs = lambda c: ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
        columns = lambda e, a, b: F.transform(F.array_sort(F.array_except(F.col(f"{a}columns"), F.col(f"{b}columns"))), lambda c: row(e, c, none, none))
        counts = [F.when(differs(c), row(e, none, F.col(f"o_{c}"), F.col(f"n_{c}"))) for c, e in (("rows", "ROW_COUNT_CHANGED"), ("width", "COL_COUNT_CHANGED"))]
        shift = F.when(differs("summary"), row("DATA_DISTRIBUTION_SHIFTED", none, none, none))
        both = F.concat(columns("COLUMN_ADDED", "n_", "o_"), columns("COLUMN_REMOVED", "o_", "n_"), F.array_compact(F.array(*counts, shift)))
        events = F.when(F.col("o_digest").isNull(), F.array(row("CSV_CREATED", none, none, none))).when(F.col("n_digest").isNull(), F.array(row("CSV_DELETED", none, none, none))).otherwise(both)
        return x.select("path", F.inline(events))


class IdentityObserver(Observer):
    """Which files stand for the same thing: the field `by` of the fields observer's states, with its newest change of content.

    Needs the observers of states and fields. Its state is the identity and whether the file's content changed in the run.
    """

    name, needs = "identity", ("state", "fields")

    def __init__(self, by: str):
        self.by = by

    def extract(self, files: DataFrame, given: Mapping[str, Output]) -> DataFrame:
        touched = given["state"].events.where("event in ('UPDATED', 'REPLACED')").select("path", F.lit(True).alias("touched"))
        x = given["fields"].states.select("path", F.col(self.by).alias("identity")).where("identity is not null")
        return x.join(touched, "path", "left").select("path", "identity", F.coalesce("touched", F.lit(False)).alias("touched"))

    def compare(self, old: DataFrame, new: DataFrame) -> DataFrame:
        moved = super().compare(old.select("path", "identity"), new.select("path", "identity"))
        touched = new.where("touched").select("path", F.lit("TOUCHED").alias("event"), F.lit("identity").alias("field"), F.lit(None).cast("string").alias("old"), F.col("identity").alias("new"))
        return moved.unionByName(touched)
