"""The registered queries over the analytics operators and the SQL they are held against."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lakelens.functions import scalar as S
from lakelens.operators import aggregates as A
from lakelens.operators import catalogue as K
from lakelens.operators import cleaning as C
from lakelens.operators import inference as I
from lakelens.operators import joins as J
from lakelens.operators import observe as O
from lakelens.operators import profile as R
from lakelens.operators import search as X
from lakelens.operators import timeseries as N
from lakelens.plans import models, records  # noqa: F401  register their queries
from lakelens.plans.registry import QUERIES, SQL, index_of, query, rounded  # noqa: F401
from lakelens.sources import text as TX

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " union all ".join(
        f"""select '{c}' as "column", count({c}) as "count", count(*) - count({c}) as nulls, round(avg({c}), 4) as mean, round(median({c}), 4) as median, round(stddev_samp({c}), 4) as std,
        round(sum({c}), 2) as sum, min({c}) as min, max({c}) as max, round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.75), 4) as q3,
        round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) as iqr from lineitem"""
        for c in NUMBERS
    )
)
def numeric_summary(t):
    x = A.numeric_summary(t("lineitem").select(*NUMBERS))
    return rounded(x.withColumn("sum", F.round("sum", 2)), 4)


@query("""
select * from (
 select 'o_orderpriority' as "column", cast(sum(n) as bigint) as "count", count(*) as "unique", arg_min(v, -n * 1000 + r) as top, max(n) as freq
 from (select o_orderpriority as v, count(*) as n, row_number() over (order by o_orderpriority) as r from orders group by 1)
 union all
 select 'o_orderstatus', cast(sum(n) as bigint), count(*), arg_min(v, -n * 1000 + r), max(n)
 from (select o_orderstatus as v, count(*) as n, row_number() over (order by o_orderstatus) as r from orders group by 1))
""")
def categorical_summary(t):
    return A.categorical_summary(t("orders"), ["o_orderpriority", "o_orderstatus"])


@query("""
select l_returnflag, l_linestatus, round(avg(l_quantity), 4) as l_quantity_mean, sum(l_quantity) as l_quantity_sum, median(l_quantity) as l_quantity_median,
 round(avg(l_extendedprice), 4) as l_extendedprice_mean, round(sum(l_extendedprice), 2) as l_extendedprice_sum, round(median(l_extendedprice), 4) as l_extendedprice_median
from lineitem group by all
""")
def group_aggregate(t):
    x = A.group_aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"], ["mean", "sum", "median"])
    return rounded(x.withColumn("l_extendedprice_sum", F.round("l_extendedprice_sum", 2)), 4)


@query("""
select n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance_sum from customer join nation on c_nationkey = n_nationkey group by n_name
""")
def bar_aggregate(t):
    x = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance_sum"))


@query("""
select regexp_replace(p_brand, '[^0-9.\\-]', '', 'g')::double as number, count(*) as n, round(avg(p_retailprice), 4) as price from part group by 1
""")
def parsed_number_bars(t):
    return t("part").groupBy(A.parsed_number("p_brand").alias("number")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("""
select c_mktsegment, round(sum(c_acctbal), 2) as total, round(sum(c_acctbal) / sum(sum(c_acctbal)) over (), 6) as share from customer group by 1
""")
def pie_shares(t):
    x = A.share_by(t("customer"), "c_mktsegment", "c_acctbal")
    return x.select("c_mktsegment", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


@query("""
with q as (select l_returnflag as g, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as med, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem group by 1)
select g as "group", round(any_value(q1), 4) as q1, round(any_value(med), 4) as med, round(any_value(q3), 4) as q3,
 min(l_extendedprice) filter (l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whislo,
 max(l_extendedprice) filter (l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whishi,
 count(*) filter (not (l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))) as fliers, round(avg(l_extendedprice), 4) as mean, count(*) as n
from lineitem join q on l_returnflag = g group by g
""")
def box_summary(t):
    return rounded(A.box_summary(t("lineitem"), "l_returnflag", "l_extendedprice"), 4)


@query("""
select o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, round(skewness(o_totalprice), 6) as skew, round(kurtosis(o_totalprice), 6) as kurtosis
from orders group by 1
""")
def skew_kurtosis(t):
    x = A.moments(t("orders"), "o_totalprice", ["o_orderpriority"])
    return x.select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"))


@query("""
with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
b as (select cast(least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) as integer) as bin, count(*) as n from orders, e group by 1)
select cast(r.bin as integer) as bin, round(lo + r.bin * ((hi - lo) / 10), 4) as low, round(lo + (r.bin + 1) * ((hi - lo) / 10), 4) as high, coalesce(n, 0) as "count"
from e, range(0, 10) r(bin) left join b on b.bin = r.bin
""")
def histogram(t):
    return rounded(A.histogram(t("orders"), "o_totalprice"), 4)


@query("""
select "column", value, "count", "rank" from (select *, row_number() over (partition by "column" order by "count" desc, value) as "rank" from (
 select 'p_brand' as "column", p_brand as value, count(*) as "count" from part group by 2 union all select 'p_type', p_type, count(*) from part group by 2)) where "rank" <= 10
""")
def value_counts(t):
    return A.value_counts(t("part"), ["p_brand", "p_type"]).select("column", "value", "count", F.col("rank").cast("long").alias("rank"))


@query("""
select "column", round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy, round(max(n) / sum(n), 6) as top_ratio from (
 select 'event_type' as "column", event_type as v, count(*) as n from events group by 2 union all select 'user_id', cast(user_id as varchar), count(*) from events group by 2) group by 1
""")
def entropy(t):
    return rounded(A.entropy(t("events"), ["event_type", "user_id"]))


@query("""
select lower(trim(tag)) as tag, count(*) as n from (select unnest(string_split(lang || ',' || source || ', ' || case when n_chars > 1000 then 'Long' else 'Short' end, ',')) as tag from documents)
group by 1 order by n desc, tag limit 10
""")
def tag_counts(t):
    return A.exploded_counts(t("documents").select(F.concat("lang", F.lit(","), "source", F.lit(", "), F.when(F.col("n_chars") > 1000, "Long").otherwise("Short")).alias("tags")), "tags")


@query("""
select user_id, arg_max(event_type, event_id) as latest, count(*) filter (event_type <> 'error') as succeeded, count(*) filter (event_type = 'error') as failed from events group by 1
""")
def telemetry_summary(t):
    x = A.telemetry(t("events").withColumn("status", F.when(F.col("event_type") == "error", "failed").otherwise("ok")), "user_id", "status", "event_id")
    last = t("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("latest"))
    return x.drop("latest").join(last, "user_id").select("user_id", "latest", "succeeded", "failed")


for _how, _sql in (("inner", "join"), ("left", "left join"), ("right", "right join"), ("outer", "full join")):

    def _join(t, how=_how):
        orders = t("orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), "o_totalprice")
        items = t("lineitem").where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity")
        return J.guarded_join([orders, items], ["k"], how, max_rows=None)

    _join.__name__ = f"join_guarded_{_how}"
    query(f"""select k, o_totalprice, l_linenumber, l_quantity from (select o_orderkey as k, o_totalprice from orders where o_orderkey % 3 <> 0) a
    {_sql} (select l_orderkey as k, l_linenumber, l_quantity from lineitem where l_orderkey % 5 <> 0) b using (k)""")(_join)


@query("""
select k, round(q.l_quantity, 3) as l_quantity, round(q.l_extendedprice, 3) as l_extendedprice, p.p_size from (select l_partkey as k, avg(l_quantity) as l_quantity, avg(l_extendedprice) as l_extendedprice from lineitem group by 1) q
join (select p_partkey as k, avg(p_size) as p_size from (select * from part union all select * from part) group by 1) p using (k)
""")
def join_pre_aggregated(t):
    items = t("lineitem").select(F.col("l_partkey").alias("k"), "l_quantity", "l_extendedprice")
    parts = t("part").select(F.col("p_partkey").alias("k"), "p_size")
    return rounded(J.guarded_join([items, parts.unionAll(parts)], ["k"], aggregate="mean"), 3)


@query("""
select cast(sum(a) as bigint) as left_rows, cast(sum(b) as bigint) as right_rows, cast(sum(a * b) as bigint) as rows from
 (select l_partkey, count(*) as a from lineitem group by 1) join (select l_partkey, count(*) as b from lineitem where l_quantity > 25 group by 1) using (l_partkey)
""")
def join_estimate(t):
    x = t("lineitem").select("l_partkey", "l_quantity")
    return J.join_estimate(x, x.where("l_quantity > 25"), ["l_partkey"])


@query("""
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'deleted'
 when a.p is not distinct from b.p and a.s is not distinct from b.s then 'unchanged' else 'modified' end as change
from (select o_orderkey, o_totalprice as p, o_orderstatus as s from orders where o_orderkey % 7 <> 0) a
full join (select o_orderkey, case when o_orderkey % 5 = 0 then null else o_totalprice end as p, o_orderstatus as s from orders where o_orderkey % 11 <> 0) b on a.o_orderkey = b.o_orderkey
""")
def manifest_diff(t):
    o = t("orders")
    new = o.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    return J.keyed_diff(o.where("o_orderkey % 7 <> 0"), new, "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("""
select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where ts <= timestamp '2024-01-15') where r = 1
""")
def asof_snapshot(t):
    x = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    return J.as_of(x, "user_id", "ts", F.to_timestamp(F.lit("2024-01-15"))).select("user_id", "event_id", "value")


@query("""
select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 10
""")
def keep_latest(t):
    return J.keep_latest(t("events").select("user_id", "event_id"), "user_id", "event_id")


@query("select doc_id, count(*) over (partition by md5(text)) > 1 as duplicate from documents")
def duplicate_documents(t):
    return J.duplicate_marks(t("documents").select("doc_id", F.md5("text").alias("hash")), "hash").select("doc_id", "duplicate")


_COLUMNS = r"""c as (select table_name as tbl, regexp_replace(regexp_replace(column_name, '^[a-z]{1,2}_', ''), 'key$', '_id') as col from information_schema.columns
 where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'labels', 'pages', 'conversations'))"""


def table_columns(t):
    """(table, column) of the given tables, the prefix of a column left out and key written as _id."""
    tables = "region nation customer supplier part orders lineitem events documents labels pages conversations".split()
    rows = [(n, re.sub("key$", "_id", re.sub("^[a-z]{1,2}_", "", c))) for n in tables for c in t(n).columns]
    return t("region").sparkSession.createDataFrame(rows, "table string, column string")


@query(f"""with {_COLUMNS} select c.tbl as "table", c.col as "column", x.tbl as target, case when x.tbl is null then 'low' else 'high' end as confidence
from c left join (select distinct tbl from c) x on x.tbl = regexp_replace(c.col, '_id$', '') where c.col like '_%\\_id' escape '\\'""")
def heuristic_relations(t):
    return J.relations(table_columns(t))


@query(f"""with {_COLUMNS} select c.tbl as "table", string_agg(distinct x.tbl, ',' order by x.tbl) as targets from c join (select distinct tbl from c) x on c.col = x.tbl || '_id' group by 1""")
def relation_graph(t):
    return J.relation_graph(J.relations(table_columns(t))).withColumn("targets", F.array_join("targets", ","))


@query(
    "with c as (select c_custkey, c_name, c_nationkey, case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment from customer) "
    + " union all ".join(
        f"""select '{c}' as "column", count(*) as rows, count(*) - count({c}) as nulls, round(100 * (count(*) - count({c})) / count(*), 2) as null_pct, count(distinct {c}) as "unique",
        count(*) - count(distinct {c}) - case when count({c}) < count(*) then 1 else 0 end as duplicates,
        case when count(distinct {c}) = count(*) then 'unique_key' when (count(*) - count(distinct {c}) - case when count({c}) < count(*) then 1 else 0 end) / count(*) < 0.01 then 'likely_key' else 'none' end as key from c"""
        for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    )
)
def profile_columns(t):
    c = t("customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return R.profile_columns(c)


@query("select count(*) as rows, cast(count(distinct (user_id, event_type)) as bigint) as distinct_rows, count(*) - count(distinct (user_id, event_type)) as duplicate_rows from events")
def duplicate_rows(t):
    return R.duplicate_rows(t("events").select("user_id", "event_type"))


@query("select o_orderkey, o_totalprice from orders order by md5(cast(o_orderkey as varchar)), o_orderkey limit 500")
def hashed_sample(t):
    return R.hashed_sample(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@query("select cast(date_trunc('day', ts) as timestamp) as bin, round(sum(value), 4) as value from events group by 1")
def resample_daily(t):
    return rounded(N.resample(t("events"), "ts", "value", "D", "sum", spine=False), 4)


@query("""
with h as (select date_trunc('hour', ts) as bin, avg(value) as v from events group by 1)
select g.bin as bin, round(v, 6) as value from (select unnest(generate_series((select min(bin) from h), (select max(bin) from h), interval 1 hour)) as bin) g left join h using (bin)
""")
def resample_spine_hourly(t):
    return rounded(N.resample(t("events"), "ts", "value", "H", "mean"))


@query("select date_trunc('week', ts) + interval 6 day as bin, cast(count(value) as double) as value from events group by 1")
def resample_weekly(t):
    return N.resample(t("events"), "ts", "value", "W", "count")


@query("""
with g as (select (epoch_us(ts) - lag(epoch_us(ts)) over (order by ts)) as g from (select distinct ts from events))
select median(g) / 1e6 as gap, case when median(g) / 1e6 <= 60 then 'S' when median(g) / 1e6 <= 3600 then 'T' when median(g) / 1e6 <= 129600 then 'H' else 'D' end as frequency from g
""")
def infer_frequency(t):
    return N.infer_frequency(t("events"), "ts")


_W7 = "over (partition by user_id order by event_id rows between 6 preceding and current row)"


@query(f"select user_id, event_id, round(avg(value) {_W7}, 6) as rolling_mean, round(sum(value) {_W7}, 6) as rolling_sum, round(stddev_samp(value) {_W7}, 6) as rolling_std, round(median(value) {_W7}, 6) as rolling_median from events")
def rolling7(t):
    x = N.rolling(t("events").select("user_id", "event_id", "value"), "event_id", "value", 7, ["mean", "sum", "std", "median"], ["user_id"])
    return rounded(x.drop("value"))


@query("""
select user_id, event_id, round(sum(value) over (partition by user_id order by epoch_us(ts) range between 259199999999 preceding and current row), 6) as rolling_sum from events
""")
def rolling_time_3d(t):
    return rounded(N.rolling_time(t("events").select("user_id", "event_id", "ts", "value"), "ts", "value", 3, "sum", ["user_id"]).select("user_id", "event_id", "rolling_sum"))


@query("""
select user_id, event_id, round(value - lag(value) over w, 6) as diff, round(sum(value) over w, 6) as cumsum,
 round(case when lag(value) over w <> 0 then (value / lag(value) over w - 1) * 100 end, 6) as pct_change from events window w as (partition by user_id order by event_id)
""")
def changes(t):
    return rounded(N.changes(t("events").select("user_id", "event_id", "value"), "event_id", "value", ["user_id"]).drop("value"))


@query("""
with m as (select event_type, median(value) as med from events group by 1),
d as (select event_type, median(abs(value - med)) as mad from events join m using (event_type) group by 1)
select event_id, 0.6745 * abs(value - med) / case when mad = 0 then 1 else mad end > 3.5 as outlier from events join m using (event_type) join d using (event_type)
""")
def outliers_mad(t):
    return N.robust_outliers(t("events").select("event_id", "event_type", "value"), "value", "event_type").select("event_id", "outlier")


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(f"select term, count(distinct doc_id) as docs, count(*) as occurrences from (select doc_id, unnest({_TOK}) as term from documents) group by 1")
def vocabulary(t):
    return X.vocabulary(t("documents"), "doc_id", "text")


@query(f"""
select term, key, count(*) as tf, array_to_string(list(pos order by pos), ',') as positions from (select doc_id as key, unnest(t) as term, unnest(range(0, len(t))) as pos from (select doc_id, {_TOK} as t from documents)) group by 1, 2
""")
def postings(t):
    return X.postings(t("documents"), "doc_id", "text").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


_FOLDED = _TOK.replace("lower(text)", "strip_accents(lower(text))")


def _bm25(units: list[str], where: str, tokens: str = _TOK) -> str:
    """SQL for a score over units, each an expression over the padded token text p."""
    tf = ", ".join(f"cast(({u}) as bigint) as u{i}" for i, u in enumerate(units))
    d = ", ".join(f"count(*) filter (u{i} > 0) as d{i}" for i in range(len(units)))
    score = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * u{i} * 2.2 / (u{i} + 1.2 * (0.25 + 0.75 * len / avglen))" for i in range(len(units)))
    return f"""with x as (select doc_id as key, len({tokens}) as len, ' ' || array_to_string({tokens}, '  ') || ' ' as p from documents where text is not null),
    y as (select key, len, {tf} from x), s as (select count(*) as n, avg(len) as avglen, {d} from y)
    select key, round({score}, 6) as score from y, s where {where}"""


def _count(phrase: str) -> str:
    """Occurrences of a phrase in the token text, whose tokens stand between single spaces, doubled in between."""
    p = "  ".join(phrase.split())
    return f"(length(p) - length(replace(p, ' {p} ', ''))) / {len(p) + 2}"


@query(_bm25([_count("the"), _count("ing")], "u0 > 0 or u1 > 0", _FOLDED))
def search_bm25(t):
    return rounded(index_of(t("documents")).search("the OR ing"))


@query(_bm25([_count("of"), _count("that"), _count("der")], "u0 > 0 and u1 > 0 and not u2 > 0"))
def search_boolean(t):
    return rounded(X.search(t("documents"), "doc_id", "text", "(of AND that) NOT der"))


@query(_bm25([_count("of the")], "u0 > 0", _FOLDED))
def search_phrase(t):
    return rounded(index_of(t("documents")).search("of the"))


@query(f"select term, count(distinct doc_id) as docs, count(*) as occurrences from (select doc_id, unnest({_FOLDED}) as term from documents) group by 1")
def index_vocabulary(t):
    return index_of(t("documents")).vocabulary()


@query()
def search_stemmed(t):
    return rounded(index_of(t("documents"), stemming=True).remembered("thinking OR \"of things\""))


@query(r"""
select doc_id as key, cast(strpos(text, regexp_extract(text, '(?i)th[a-z]+ing')) as integer) as at,
 substr(text, greatest(strpos(text, regexp_extract(text, '(?i)th[a-z]+ing')) - 30, 1),
  strpos(text, regexp_extract(text, '(?i)th[a-z]+ing')) - greatest(strpos(text, regexp_extract(text, '(?i)th[a-z]+ing')) - 30, 1) + length(regexp_extract(text, '(?i)th[a-z]+ing')) + 30) as snippet
from documents where regexp_matches(text, '(?i)th[a-z]+ing')
""")
def regex_search(t):
    return X.regex_search(t("documents"), "doc_id", "text", "th[a-z]+ing")


@query("select doc_id as path, md5(text || case when doc_id % 9 = 0 then '!' else '' end) as hash from documents where doc_id % 9 = 0 or doc_id % 4 = 1")
def incremental_index(t):
    d = t("documents")
    files = d.select(F.col("doc_id").alias("path"), F.md5(F.concat("text", F.when(F.col("doc_id") % 9 == 0, "!").otherwise(""))).alias("hash"))
    return X.unchanged(d.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash")), files)


@query(r"select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '[\x00-\x1F\x7F-\x{9F}]', '', 'g'))) as cleaned from documents")
def clean_text(t):
    return t("documents").select("doc_id", F.md5(S.clean_text("text")).alias("cleaned"))


@query(r"""
select doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) >= 3 and not regexp_matches(x, '^\d+$')), ' ')) as kept from documents
""")
def semantic_filter(t):
    return t("documents").select("doc_id", F.md5(S.semantic_filter("text")).alias("kept"))


@query("""
select o_orderkey, year(o_orderdate) as d_year, month(o_orderdate) as d_month, day(o_orderdate) as d_day, dayname(o_orderdate) as d_weekday, hour(o_orderdate) as d_hour, quarter(o_orderdate) as d_quarter,
 monthname(o_orderdate) as d_month_name, weekofyear(o_orderdate) as d_week, dayofyear(o_orderdate) as d_day_of_year, minute(o_orderdate) as d_minute, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as d_iso, cast(epoch(o_orderdate) as bigint) as d_epoch from orders
""")
def date_parts(t):
    x = t("orders").select("o_orderkey", *S.date_parts("o_orderdate", "d"))
    return x.select(*[F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in x.dtypes])


@query("""
select o_orderkey, date_trunc('day', o_orderdate) as parsed from orders
""")
def date_cascade(t):
    d = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d/M/yyyy")).when(k == 2, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "d.M.yyyy"))
    return t("orders").select("o_orderkey", S.parse_date(text).alias("parsed"))


@query("select c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) as log, round(sqrt(greatest(c_acctbal, 0)), 6) as sqrt, round(ln(1 + exp(c_acctbal / 1000)), 6) as soft from customer")
def number_transforms(t):
    return rounded(t("customer").select("c_custkey", S.transform_number("c_acctbal", "log").alias("log"), S.transform_number("c_acctbal", "sqrt").alias("sqrt"), S.transform_number(F.col("c_acctbal") / 1000, "softplus").alias("soft")))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def flatten_props(t):
    return t("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""
select o_orderkey, coalesce(case when o_orderkey % 7 <> 0 then o_totalprice end, (select avg(o_totalprice) from orders where o_orderkey % 7 <> 0)) as o_totalprice,
 coalesce(case when o_orderkey % 5 <> 0 then o_orderpriority end, (select o_orderpriority from orders where o_orderkey % 5 <> 0 group by 1 order by count(*) desc, 1 limit 1)) as o_orderpriority from orders
""".replace("coalesce(case when o_orderkey % 7", "round(coalesce(case when o_orderkey % 7").replace("o_orderkey % 7 <> 0)) as o_totalprice", "o_orderkey % 7 <> 0)), 4) as o_totalprice"))
def auto_clean_fill(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return rounded(C.fill_missing(o, "mean", ["o_totalprice", "o_orderpriority"]), 4)


@query("""
with a as (select l_orderkey, l_linenumber, l_extendedprice, l_quantity from lineitem, (select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem)
 where l_extendedprice between q1 - 0.3 * (q3 - q1) and q3 + 0.3 * (q3 - q1))
select l_orderkey, l_linenumber from a, (select quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.75) as q3 from a) where l_quantity between q1 - 0.3 * (q3 - q1) and q3 + 0.3 * (q3 - q1)
""")
def outliers_iqr_sequential(t):
    return C.drop_outliers(t("lineitem"), ["l_extendedprice", "l_quantity"], limit=0.3).select("l_orderkey", "l_linenumber")


@query("select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over (), 6) as c_acctbal from customer")
def zscore(t):
    return rounded(C.normalise(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("select c_custkey, round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) as c_acctbal from customer")
def minmax(t):
    return rounded(C.normalise(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "minmax"))


@query("select 'l_quantity' as x, 'l_extendedprice' as y, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem union all select 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) from lineitem union all select 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) from lineitem")
def pearson_matrix(t):
    return rounded(I.correlation_matrix(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("select count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def pearson(t):
    return rounded(I.correlation(t("lineitem"), "l_quantity", "l_extendedprice").select("n", "r"))


_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"


@query(f"select count(*) as n, round(corr(a, b), 6) as r from (select {_RANK.format('l_quantity')} as a, {_RANK.format('l_extendedprice')} as b from lineitem)")
def spearman(t):
    return rounded(I.spearman(t("lineitem"), "l_quantity", "l_extendedprice").select("n", "r"))


@query("""
with g as (select l_linestatus as g, count(*) as n, avg(l_extendedprice) as m, var_samp(l_extendedprice) as v from lineitem group by 1),
p as (select a.n as n1, a.m as m1, a.v as v1, b.n as n2, b.m as m2, b.v as v2 from g a, g b where a.g < b.g)
select round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) as t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 2) as df, round(m1 - m2, 2) as diff from p
""")
def welch_t(t):
    return I.t_test(t("lineitem"), "l_extendedprice", "l_linestatus").select(F.round("t", 4).alias("t"), F.round("df", 2).alias("df"), F.round("diff", 2).alias("diff"))


@query("select count(*) as n, round(avg(l_quantity - l_tax * 500) / (stddev_samp(l_quantity - l_tax * 500) / sqrt(count(*))), 4) as t from lineitem")
def paired_t(t):
    return rounded(I.paired_t_test(t("lineitem").withColumn("x", F.col("l_tax") * 500), "l_quantity", "x").select("n", "t"), 4)


_ANOVA = """
with g as (select {g} as g, count(*) as n, avg({v}) as m, var_samp({v}) as v from {t} group by 1), a as (select sum(n * m) / sum(n) as gm, count(*) as k, sum(n) as n from g)
select cast(any_value(a.k) as bigint) as k, cast(any_value(a.n) as bigint) as n, round(sum(g.n * (m - gm) ** 2) / (any_value(a.k) - 1) / (sum((g.n - 1) * v) / (any_value(a.n) - any_value(a.k))), 4) as f from g, a
"""


@query(_ANOVA.format(g="event_type", v="value", t="events"))
def anova_f(t):
    return rounded(I.anova(t("events"), "value", "event_type").select("k", "n", "f"), 4)


@query(_ANOVA.format(g="event_type", v="z", t="(select event_type, abs(value - median(value) over (partition by event_type)) as z from events)"))
def levene_f(t):
    return rounded(I.levene(t("events"), "value", "event_type").select("k", "n", "f"), 4)


@query(f"select round(sum(r) filter (g = 'F') - count(*) filter (g = 'F') * (count(*) filter (g = 'F') + 1) / 2.0, 1) as u from (select l_linestatus as g, {_RANK.format('l_quantity')} as r from lineitem)")
def mannwhitney_u(t):
    return rounded(I.mann_whitney(t("lineitem"), "l_quantity", "l_linestatus").select("u"), 1)


@query(f"""
with r as (select l_returnflag as g, l_quantity as v, {_RANK.format('l_quantity')} as r from lineitem), n as (select count(*)::double as n from r),
ties as (select sum(c ** 3 - c) as t from (select count(*)::double as c from r group by v)), s as (select g, sum(r) as s, count(*) as c from r group by 1)
select count(*) as k, round((12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / c) - 3 * (any_value(n) + 1)) / (1 - any_value(t) / (any_value(n) ** 3 - any_value(n))), 4) as h from s, n, ties
""")
def kruskal_h(t):
    return rounded(I.kruskal(t("lineitem"), "l_quantity", "l_returnflag").select("k", "h"), 4)


@query("select 'intercept' as term, round(regr_intercept(l_extendedprice, l_quantity), 3) as coefficient from lineitem union all select 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) from lineitem")
def ols_coefficients(t):
    return rounded(I.ols(t("lineitem"), "l_extendedprice", ["l_quantity"]).select("term", "coefficient"), 3)


@query("""
select term, 1 / (1 - r * r) as vif from (select unnest(['l_quantity', 'l_extendedprice']) as term, corr(l_quantity, l_extendedprice) as r from lineitem)
""".replace("1 / (1 - r * r)", "round(1 / (1 - r * r), 6)"))
def vif(t):
    return rounded(I.vif(t("lineitem"), ["l_quantity", "l_extendedprice"]))


# the quantile of Student's t from the normal one, to second order in 1 / (n - 1)
@query("""
with x as (select count(*) as n, avg(o_totalprice) as mean, stddev_samp(o_totalprice) / sqrt(count(*)) as se, 1.959963984540054 as z from orders),
y as (select *, z + (z ** 3 + z) / (4 * (n - 1)) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96e0 * (n - 1) ** 2) as t from x)
select n, round(mean, 4) as mean, round(mean - t * se, 2) as low, round(mean + t * se, 2) as high from y
""")
def mean_interval(t):
    return I.mean_interval(t("orders"), "o_totalprice").select("n", F.round("mean", 4).alias("mean"), F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


@query("""
with x as (select count(*) as n, avg(case when event_type = 'purchase' then 1e0 else 0e0 end) as p from events), y as (select *, 1.959963984540054 * sqrt(p * (1 - p) / n) as half from x)
select n, round(p, 6) as p, round(greatest(p - half, 0), 6) as low, round(least(p + half, 1), 6) as high from y
""")
def proportion_interval(t):
    return rounded(I.proportion_interval(t("events"), "event_type = 'purchase'").select("n", "p", "low", "high"))


@query("""
with x as (select n_name as name, (n_nationkey * 37 % 25 + 1) / 500.0 as p from nation), y as (select *, count(*) over () as n, row_number() over (order by p, name) as i from x)
select name, p::double as p, round(least(p * n, 1), 6)::double as bonferroni, round(least(max(p * (n - i + 1)) over (order by i), 1), 6)::double as holm, round(least(min(p * n / i) over (order by i desc), 1), 6)::double as bh from y
""")
def adjusted_p(t):
    x = t("nation").select(F.col("n_name").alias("name"), ((F.col("n_nationkey") * 37 % 25 + 1) / F.lit(500.0)).cast("double").alias("p"))
    return rounded(I.adjust_p(x, "name", "p"))


@query("select user_id, round(sum(d * d) / sum(value * value), 6) as dw from (select user_id, value, value - lag(value) over (partition by user_id order by event_id) as d from events) group by 1")
def durbin_watson(t):
    return rounded(I.durbin_watson(t("events"), "value", "event_id", "user_id"))


@query("""
select doc_id, case when a.h is null then 'CREATED' when b.h is null then 'DELETED' when a.s = b.s then 'REPLACED' else 'UPDATED' end as event from
 (select doc_id, md5(text) as h, length(text) as s from documents where doc_id % 5 <> 0) a full join
 (select doc_id, md5(t) as h, length(t) as s from (select doc_id, case when doc_id % 3 = 0 then reverse(text) when doc_id % 4 = 0 then text || '.' else text end as t from documents where doc_id % 7 <> 0)) b using (doc_id)
where a.h is distinct from b.h
""")
def state_events(t):
    d = t("documents")
    make = lambda x: x.select("doc_id", F.md5("text").alias("h"), F.length("text").alias("s"))
    new = d.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.reverse("text")).when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return O.state_events(make(d.where("doc_id % 5 <> 0")), make(new), "doc_id", "h", "s")


@query("""
select user_id, event_id, 'event_type' as field, old, event_type as new from (select *, lag(event_type) over (partition by user_id order by event_id) as old, row_number() over (partition by user_id order by event_id) as n from events)
where n > 1 and old is distinct from event_type
""")
def field_events(t):
    return O.field_events(t("events"), "user_id", "event_id", ["event_type"])


@query("""
select count(*) filter (a.h = b.h) as identical, count(*) filter (a.h <> b.h) as modified, count(*) filter (a.h is null) as missing_a, count(*) filter (b.h is null) as missing_b
from (select doc_id, md5(text) as h from documents where doc_id % 5 <> 0) a full join (select doc_id, md5(case when doc_id % 3 = 0 then text || '.' else text end) as h from documents where doc_id % 7 <> 0) b using (doc_id)
""")
def compare_folders(t):
    d = t("documents")
    b = d.where("doc_id % 7 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("h"))
    return O.compare_folders(d.where("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("h")), b, "doc_id", "h")


@query("""
with recursive c as (select o_orderkey as key, o_orderkey as root, 0::bigint as depth from orders where o_orderkey < 5 union all
 select o.o_orderkey, c.root, c.depth + 1 from orders o join c on o.o_orderkey // 5 = c.key where o.o_orderkey >= 5)
select o_orderkey as key, root, depth from (select o_orderkey from orders) left join c on key = o_orderkey
""")
def chain_closure(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") >= 5, F.floor(F.col("o_orderkey") / 5)).alias("parent"))
    return O.chains(o.sparkSession, o, "o_orderkey", "parent")


@query("select doc_id, case when n = 1 then lang else lang || '_' || lpad(cast(n - 1 as varchar), 2, '0') end as unique_target from (select doc_id, lang || '-' || source as lang, row_number() over (partition by lang, source order by doc_id) as n from documents)")
def numbered_targets(t):
    x = t("documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("target"))
    return O.numbered_targets(x, "target", "doc_id").select("doc_id", "unique_target")


@query("""
select user_id, event_id, row_number() over (partition by user_id, run order by event_id) as counter from (select *, sum(new) over (partition by user_id order by event_id) as run from (
 select user_id, event_id, case when cast(ts as date) is not distinct from lag(cast(ts as date)) over (partition by user_id order by event_id) then 0 else 1 end as new from events))
""")
def day_counters(t):
    x = t("events").select("user_id", "event_id", F.to_date("ts").alias("day"))
    return O.day_counters(x, "day", "event_id", "user_id").select("user_id", "event_id", F.col("counter").cast("long").alias("counter"))


@query("select source, sha256(string_agg(r, chr(10) order by r)) as fingerprint from (select source, doc_id || '|' || n_chars as r from documents) group by 1")
def folder_fingerprint(t):
    return O.fingerprint(t("documents").select("source", F.col("doc_id").cast("string").alias("doc_id"), F.col("n_chars").cast("string").alias("n_chars")), ["doc_id", "n_chars"], "source")


@query("select doc_id from documents where lang in ('de', 'es') or source = 'src3'")
def tags_any(t):
    return K.with_any_tag(t("documents").select("doc_id", F.array("lang", "source").alias("tags")), "tags", ["de", "es", "src3"]).select("doc_id")


@query("select doc_id from documents where contains(lower(source), 'c1') or contains(lang, 'c1')")
def tags_part(t):
    return K.with_tag_part(t("documents").select("doc_id", F.array("lang", "source").alias("tags")), "tags", "C1").select("doc_id")


@query("select page_id from pages where lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '\\.([^./]+)$', 1)) in ('com', 'html', 'php') or contains(lower(url), '/en/')")
def path_filters(t):
    p = t("pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"), "url")
    return p.where(K.filters(["com", "HTML", ".php"]) | K.filters(path_part="/EN/", path="url")).select("page_id")


@query("select event_id from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-07 12:00:00'")
def date_filter(t):
    e = t("events").select("event_id", F.col("ts").cast("timestamp").alias("modified"))
    return e.where(K.filters(after=F.to_timestamp(F.lit("2024-01-05")), before=F.to_timestamp(F.lit("2024-01-07 12:00:00")))).select("event_id")


@query("select count(*) as rows, count(l.doc_id) as tagged, count(*) - count(l.doc_id) as untagged, round(100 * count(l.doc_id) / count(*), 2) as percent from documents d left join (select distinct doc_id from labels) l using (doc_id)")
def tag_coverage(t):
    return K.tag_coverage(t("documents").select("doc_id"), t("labels").select("doc_id", F.col("quality").cast("string").alias("tag")), "doc_id")


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders group by 1")
def counts_by_month(t):
    return K.by_month(t("orders"), "o_orderdate")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def delete_paths(t):
    return K.delete_paths(t("documents").select("doc_id", "source"), t("labels").where("toxic = 1"), "doc_id")


@query("select c_custkey, c_acctbal from customer where c_custkey % 4 <> 0 union all select c_custkey, -1.0::double from customer where c_custkey % 4 = 0")
def upsert(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    return K.upsert(c, c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.lit(-1.0)), "c_custkey")


@query("select min(doc_id) as doc_id, md5(text) as hash from documents group by 2")
def first_occurrences(t):
    return K.first_occurrences(t("documents").select("doc_id", F.md5("text").alias("hash")), "hash", "doc_id")


@query("""
select l_orderkey, round(sum(l_quantity * l_extendedprice), 2) as net, round(sum(l_quantity * l_extendedprice * l_tax / 100), 2) as tax, round(sum(l_quantity * l_extendedprice) + sum(l_quantity * l_extendedprice * l_tax / 100), 2) as gross,
 abs(sum(l_quantity * l_extendedprice) + sum(l_quantity * l_extendedprice * l_tax / 100) - any_value(o_totalprice)) < 1 as agrees from lineitem join orders on l_orderkey = o_orderkey group by 1
""")
def invoice_totals(t):
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(K.invoice_totals(x, "l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "o_totalprice"), 2)


@query("""
select 'c' as dataset, 'bal' as variable, c_acctbal::double as value from customer where c_acctbal is not null union all select 'c', 'key', c_nationkey from customer
union all select 's', 'bal', s_acctbal from supplier union all select 's', 'key', s_nationkey from supplier
""")
def long_form(t):
    c = t("customer").select(F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("key"))
    s = t("supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("key"))
    return K.long_form({"c": c, "s": s}, ["bal", "key"])


_NEAR = r"""select key from (select doc_id as key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from documents)
where len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'of' and len(list_filter(range(greatest(i - 4, 1), least(i + 4, len(t)) + 1), lambda j: t[j] = 'and')) > 0)) > 0"""


@query(_NEAR)
def search_near(t):
    return X.search(t("documents"), "doc_id", "text", "NEAR(of and, 3)").select("key")


@query(r"select doc_id as key from documents where len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: starts_with(x, 'thst'))) > 0")
def search_prefix(t):
    return X.search(t("documents"), "doc_id", "text", "thst*").select("key")


@query("""
select page_id, case when contains(lower(url), '/de') then 'german' when regexp_matches(lower(url), '\\d{3}') then 'numbered' when starts_with(lower(url), 'https') then 'secure' else 'other' end as label from pages
""")
def classify_paths(t):
    return t("pages").select("page_id", O.classify("url", [("/de", "german"), (r"\d{3}", "numbered"), ("^https", "secure")], "other").alias("label"))


@query("""
select doc_id, line_no, old, new from (
 select doc_id, line_no, old, new from (select doc_id, unnest(l) as old, unnest(range(0, len(l))) as line_no from (select doc_id, string_split(text, chr(10)) as l from documents)) a
 full join (select doc_id, unnest(l) as new, unnest(range(0, len(l))) as line_no from (select doc_id, string_split(case when doc_id % 3 = 0 then replace(text, 'the', 'The') else text end, chr(10)) as l from documents)) b using (doc_id, line_no))
where old is distinct from new
""")
def compare_lines(t):
    d = t("documents").select("doc_id", "text")
    new = d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("the"), F.lit("The"))).otherwise(F.col("text")))
    return O.compare_lines(d, new, "doc_id", "text").select(F.col("key").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "old", "new")


@query()
def page_text(t):
    return t("pages").select("page_id", TX.html_to_text("html").alias("text"))


@query()
def fuzzy_terms(t):
    return X.vocabulary(t("documents"), "doc_id", "text").withColumn("score", F.round(TX.fuzzy_score("term", "thinking"), 4)).orderBy(F.desc("score"), "term").limit(5)
