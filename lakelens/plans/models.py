"""Queries over linear models, comparisons of texts and what else has its own operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakelens.operators import inference as I
from lakelens.operators import invoices as B
from lakelens.operators import linediff as D
from lakelens.operators import observers as V
from lakelens.operators import profiles as R
from lakelens.operators import regression as M
from lakelens.operators import reports as W
from lakelens.operators import timeseries as N
from lakelens.plans.registry import query, rounded
from lakelens.sources import datasets as DS
from lakelens.sources import preflight as PF
from lakelens.sources.shared import shared_folder, staged


def fitted(df, formula, errors, *figures):
    """A fit's terms with some of the model's figures beside them."""
    fit = M.least_squares(df, formula, errors)
    x = fit.table(df).select("term", "coefficient", "std_error")
    return rounded(x.select("*", *[F.lit(fit.model[f]).alias(f) for f in figures]), 5)


@query("""
with d as (select l_extendedprice as y, l_quantity as x from lineitem), m as (select count(*) as n, avg(x) as mx, var_pop(x) * count(*) as sxx, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_r2(y, x) as r2 from d),
e as (select x, y - a - b * x as e, 1.0 / n + (x - mx) ** 2 / sxx as h, m.* from d, m), s as (select n * corr(e * e, x) ** 2 as bp from e group by n)
select 'intercept' as term, round(any_value(a), 5) as coefficient, round(sqrt(sum((1.0 / n - mx * (x - mx) / sxx) ** 2 * (e / (1 - h)) ** 2)), 5) as std_error, round((select bp from s), 5) as bp, round(any_value(r2), 5) as r2 from e
union all select 'l_quantity', round(any_value(b), 5), round(sqrt(sum((x - mx) ** 2 * (e / (1 - h)) ** 2)) / any_value(sxx), 5), round((select bp from s), 5), round(any_value(r2), 5) from e
""")
def ols_robust(t):
    return fitted(t("lineitem"), "l_extendedprice ~ l_quantity", "hc3", "bp", "r2")


@query("""
with g as (select event_type as g, count(*) as n, avg(value) as m, var_pop(value) * count(*) as ss from events where value is not null and event_type is not null group by 1),
b as (select *, (select sum(ss) from g) / ((select sum(n) from g) - (select count(*) from g)) as s2, min(g) over () as g0, first(n) over (order by g) as n0, first(m) over (order by g) as m0 from g)
select case when g = g0 then 'intercept' else 'C(event_type)[' || g || ']' end as term, round(case when g = g0 then m else m - m0 end, 5) as coefficient, round(sqrt(s2 * (1.0 / n + case when g = g0 then 0 else 1.0 / n0 end)), 5) as std_error,
 round((select (sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (count(*) - 1) from g) / s2, 5) as f from b
""")
def ols_categories(t):
    return fitted(t("events"), "value ~ event_type", "plain", "f")


@query("""
with g as (select l_linestatus as g, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem group by 1), f as (select * from g where g = 'F'), o as (select * from g where g = 'O')
select 'intercept' as term, round(a, 5) as coefficient from f union all select 'l_quantity', round(b, 5) from f union all select 'C(l_linestatus)[O]', round(o.a - f.a, 5) from f, o union all select 'l_quantity:C(l_linestatus)[O]', round(o.b - f.b, 5) from f, o
""")
def ols_interaction(t):
    return fitted(t("lineitem"), "l_extendedprice ~ l_quantity * l_linestatus", "auto").select("term", "coefficient")


@query("select round(regr_slope(o_totalprice, epoch(o_orderdate)) * 86400 * 365, 4) as a_year, round(regr_r2(o_totalprice, epoch(o_orderdate)), 8) as r2 from orders")
def ols_time(t):
    o = t("orders")
    fit = M.least_squares(o, "o_totalprice ~ o_orderdate")
    return o.sparkSession.range(1).select(F.round(F.lit(fit.terms[1][1] * 86400 * 365), 4).alias("a_year"), F.round(F.lit(fit.model["r2"]), 8).alias("r2"))


@query()
def mixed_model(t):
    x = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    fit = M.random_intercept(x, "l_extendedprice ~ l_quantity + p_size", "l_partkey")
    return fit.table(x).select("*", *[F.lit(fit.model[k]).alias(k) for k in ("n", "groups", "log_likelihood", "sigma2", "tau2")])


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where doc_id % 3 = 0)
select doc_id, count(*) as removed, count(*) as added from l where contains(line, 'the') group by 1
""")
def line_differences(t):
    d = t("documents").select("doc_id", "text")
    new = d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("the"), F.lit("THE"))).otherwise(F.col("text")))
    x = D.line_diff(d, new, "doc_id", "text", 0)
    return x.where("sign in ('-', '+')").groupBy(F.col("key").alias("doc_id")).agg(F.count_if(F.col("sign") == "-").alias("removed"), F.count_if(F.col("sign") == "+").alias("added"))


@query("""
select doc_id as key, case when doc_id % 5 = 0 then 'missing_b' when doc_id % 3 = 0 and length(text) > 0 and octet_length(encode(text)) > 2000 - 1 then 'large' when doc_id % 3 = 0 then 'changed' else 'identical' end as status,
 case when doc_id % 5 = 0 or (doc_id % 3 = 0 and octet_length(encode(text)) > 1999) then null when doc_id % 3 = 0 then round(2e0 * length(text) / (2 * length(text) + 1), 6) else 1 end as ratio from documents
""")
def compare_texts(t):
    d = t("documents").select("doc_id", "text")
    new = d.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("§"))).otherwise(F.col("text")))  # two bytes, as the SQL reckons
    return rounded(D.compare_texts(d, new, "doc_id", "text", limit=2001).select("key", "status", "ratio"))


@query("""
with d as (select doc_id, text, case when doc_id % 7 = 1 then text || '!' when doc_id % 7 = 2 then replace(text, 'the', 'THE') else text end as now from documents where text is not null),
x as (select doc_id, text, now, sha256(text) as a, sha256(now) as b, nullif(trim(regexp_extract(text, '([A-Z][a-z]+) the', 1)), '') as f, nullif(trim(regexp_extract(now, '([A-Z][a-z]+) the', 1)), '') as g from d)
select 'state' as observer, cast(doc_id as varchar) as path, case when doc_id % 5 = 0 then 'DELETED' when doc_id % 7 = 2 then 'REPLACED' else 'UPDATED' end as event, 'digest' as field, a as old, case when doc_id % 5 > 0 then b end as new from x where doc_id % 5 = 0 or a <> b
union all select 'fields', cast(doc_id as varchar), case when doc_id % 5 = 0 then 'DELETED' else 'CHANGED' end, case when doc_id % 5 > 0 then 'lead' end, case when doc_id % 5 > 0 then f end, case when doc_id % 5 > 0 then g end from x where doc_id % 5 = 0 or f is distinct from g
union all select 'identity', cast(doc_id as varchar), 'TOUCHED', 'identity', null, g from x where doc_id % 5 > 0 and a <> b and g is not null
union all select 'identity', cast(doc_id as varchar), case when g is null or doc_id % 5 = 0 then 'DELETED' when f is null then 'CREATED' else 'CHANGED' end, case when doc_id % 5 > 0 and f is not null and g is not null then 'identity' end,
 case when doc_id % 5 > 0 and f is not null and g is not null then f end, case when doc_id % 5 > 0 and f is not null and g is not null then g end from x where (doc_id % 5 = 0 and f is not null) or (doc_id % 5 > 0 and f is distinct from g)
""")
def observer_graph(t):
    d = t("documents").where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    now = F.when(F.col("doc_id") % 7 == 1, F.concat("content", F.lit("!"))).when(F.col("doc_id") % 7 == 2, F.replace("content", F.lit("the"), F.lit("THE"))).otherwise(F.col("content"))
    store = V.SnapshotStore(d.sparkSession, f"{shared_folder(d.sparkSession)}/observed-{uuid.uuid4().hex}")
    known = V.Registry().add(V.IdentityObserver("lead"), V.StateObserver(), V.FieldObserver({"lead": ["(?-i:([A-Z][a-z]+) the)"]}))
    V.observe(d, known, store)
    return V.observe(d.where("doc_id % 5 > 0").withColumn("content", now), known, store)[0]


@query("""
with g as (select l_returnflag as g, count(*) as n, avg(l_quantity) as m, var_pop(l_quantity) * count(*) as ss from lineitem where l_quantity is not null and l_returnflag is not null group by 1),
e as (select count(*) as k, sum(n)::bigint as n, sum(ss) as within, sum(n * m * m) - sum(n * m) ** 2 / sum(n) as among from g) select k, n, round(sqrt(among / within), 6) as f from e
""")
def anova_effect(t):
    return rounded(I.anova_power(t("lineitem"), "l_quantity", "l_returnflag").select("k", "n", "f"))


@query("""
with g as (select event_type as g, count(*) as n, avg(value) as m, var_samp(value) as v from events where event_type in ('view', 'click') group by 1 order by 1), a as (select * from g where g = 'click'), b as (select * from g where g = 'view')
select a.n as n1, b.n as n2, round(abs(a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) as d from a, b
""")
def t_effect(t):
    return rounded(I.t_power(t("events").where("event_type in ('view', 'click')"), "value", "event_type").select("n1", "n2", "d"))


_TEXTS = """(select item_id as k, case when item_id % 6 = 0 then '{"a": ' when item_id % 6 = 1 then '[' || item_id || ']' when item_id % 6 = 2 then '  ' when item_id % 6 = 3 then cast(item_id as varchar) else '{"t": ' || to_json(text) || '}' end as line
 from (select conv_id * 100 + turn as item_id, text from conversations where text is not null))"""


@query(f"select case when k % 6 = 0 then 'invalid' when k % 6 = 1 then 'array' when k % 6 = 2 then 'blank' when k % 6 = 3 then 'scalar' else 'object' end as kind, count(*) as rows from {_TEXTS} group by 1")
def preflight_json(t):
    c = t("conversations").where("text is not null").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.to_json(F.struct(F.col("text").alias("t"))).alias("j"))
    r = F.col("k") % 6
    line = F.when(r == 0, '{"a": ').when(r == 1, F.concat(F.lit("["), "k", F.lit("]"))).when(r == 2, "  ").when(r == 3, F.col("k").cast("string")).otherwise(F.col("j"))
    return PF.check_json_lines(c.select(line.alias("line")), "line").select("kind", "rows")


@query("""
select page_id as key, case when page_id % 5 = 0 then 'empty' when page_id % 5 = 1 then 'no_root' when page_id % 5 = 2 then 'unclosed' else 'unbalanced' end as problem from pages where page_id % 5 < 4
""")
def preflight_xml(t):
    title = F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), r"[<>&\"']", "")
    r = F.col("page_id") % 5
    x = F.when(r == 0, "").when(r == 1, title).when(r == 2, F.concat(F.lit("<p><t>"), title, F.lit("</p>"))).when(r == 3, F.concat(F.lit("<p><t>"), title, F.lit("</t></q>"))).otherwise(F.concat(F.lit("<p a='1>0'><t>"), title, F.lit("</t></p>")))
    return PF.check_xml(t("pages").select("page_id", x.alias("x")), "page_id", "x").withColumn("problem", F.when((F.col("key") % 5 == 1) & (F.col("problem") == "empty"), "no_root").otherwise(F.col("problem")))


@query(
    """select 'supplier' as "table", count(*) as rows, 3 as columns from supplier union all select 'nation', count(*), 3 from nation union all select 'customer', count(*), 3 from customer"""
)
def profiles_at_once(t):
    tables = {"supplier": t("supplier"), "nation": t("nation"), "customer": t("customer")}
    got = R.profile_tables({n: df.select(*df.columns[:3]) for n, df in tables.items()})
    return got.tables.where("status = 'done'").select("table", "rows", "columns")


@query("""
with e as (select event_id, event_type as t, value as v from events where event_id % 13 <> 0)
select 'type' as path, 'string' as kind, count(*) as reports, count(*) as rows, null::double as total from e where event_id % 11 > 0 union all select 'type', 'null', count(*), count(*), null from e where event_id % 11 = 0
union all select 'data.value', 'number', count(*), count(*), round(sum(v), 4) from e where v is not null union all select 'data.ids', 'number', count(*), 2 * count(*), sum(2 * event_id + 1)::double from e where event_id % 2 = 0
union all select 'data.ids', 'array', count(*), count(*), null from e where event_id % 2 = 1
""")
def report_roll_up(t):
    ids = F.when(F.col("event_id") % 2 == 0, F.array("event_id", F.col("event_id") + 1)).otherwise(F.array().cast("array<bigint>"))
    kind = F.when(F.col("event_id") % 11 > 0, F.col("event_type"))
    text = F.to_json(F.struct(kind.alias("type"), F.struct(F.col("value"), ids.alias("ids")).alias("data")), {"ignoreNullFields": "false"})
    x = t("events").select("event_id", F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(text).alias("j"))
    rows = W.rolled_up(W.json_paths(x, "event_id", "j")).where("not (path = 'data.value' and kind = 'null')")
    return rounded(rows.select("path", "kind", "reports", "rows", "total"), 4)


@query("""
select event_id as key, case when event_id % 13 = 0 then 0e0 when event_id % 3 = 0 then 75e-2 else 25e-2 end as share, event_id % 13 > 0 and event_id % 3 = 0 as recognised from events
""")
def report_recognition(t):
    text = F.when(F.col("event_id") % 13 == 0, F.lit("[")).when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.struct(F.col("value"), F.col("event_type")).alias("metrics"), F.lit(1).alias("run")))).otherwise(F.to_json(F.struct(F.lit(1).alias("run"), F.lit(2).alias("metric"))))
    x = t("events").select("event_id", text.alias("j"))
    return W.recognised(W.json_paths(x, "event_id", "j"), {"metrics": 2.0, "run": 1.0, "absent": 1.0}, 0.6)


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def committed_parts(t):
    e, path = t("events"), f"{shared_folder(t('events').sparkSession)}/parts-{uuid.uuid4().hex}"
    for run in (0, 1, 1, 2, 0):
        DS.write_parts(e.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == run), path, f"third {run}")
    return rounded(DS.read_parts(e.sparkSession, path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("""
select 'orders' as name, 'orders.parquet' as file_name, count(*) as rows, count(*) filter (where o_orderstatus = 'F') as raw_rows, 2 as cleaned_version from orders
union all select 'orders.parquet', 'orders.parquet', count(*), count(*), 1 from lineitem union all select 'nation', 'nation.parquet', count(*), count(*), 1 from nation
""")
def dataset_registry(t):
    o = t("orders")
    r = DS.Registry(o.sparkSession, f"{shared_folder(o.sparkSession)}/registry-{uuid.uuid4().hex}")
    done = o.where("o_orderstatus = 'F'")
    for source, cleaned, raw in (("/a/orders.parquet", done, o), ("/b/orders.parquet", t("lineitem"), t("lineitem")), ("/a/orders.parquet", o, done), ("/a/nation.parquet", t("nation"), t("nation"))):
        r.register(source, cleaned.select(*cleaned.columns[:3]), raw.select(*raw.columns[:2]))
    parts = [r.read(n, "raw").agg(F.lit(n).alias("name"), F.count("*").alias("raw_rows")) for n in ("orders", "orders.parquet", "nation")]
    raw = parts[0].union(parts[1]).union(parts[2])
    return r.records().join(raw, "name").select("name", "file_name", "rows", "raw_rows", "cleaned_version")


@query("""
with o as (select o_orderkey, case o_orderkey % 4 when 0 then 'CII' when 1 then 'UBL' else 'EN16931' end as shape from orders where o_orderkey % 4 < 3), l as (select l_orderkey, l_quantity::decimal(24, 6) as q, l_extendedprice::decimal(24, 6) as p from lineitem)
select shape, count(distinct o_orderkey) as invoices, count(*) as lines, sum(q)::double as quantity, sum(p)::double as price, count(distinct o_orderkey) as with_total from o join l on o_orderkey = l_orderkey group by 1
""")
def invoice_shapes(t):
    l = t("lineitem").select("l_orderkey", *[F.col(c).cast("decimal(24,6)").cast("string").alias(n) for c, n in (("l_quantity", "q"), ("l_extendedprice", "p"))])
    r = F.col("l_orderkey") % 4
    cell = lambda form: F.format_string(form, "q", "p")
    line = F.when(r == 0, cell("<ram:IncludedSupplyChainTradeLineItem><ram:SpecifiedLineTradeDelivery><ram:BilledQuantity unitCode='H87'>%s</ram:BilledQuantity></ram:SpecifiedLineTradeDelivery><ram:SpecifiedLineTradeAgreement><ram:NetPriceProductTradePrice><ram:ChargeAmount>%s</ram:ChargeAmount></ram:NetPriceProductTradePrice></ram:SpecifiedLineTradeAgreement></ram:IncludedSupplyChainTradeLineItem>"))
    line = line.when(r == 1, cell("<cac:InvoiceLine><cbc:ID> </cbc:ID><cbc:InvoicedQuantity>%s</cbc:InvoicedQuantity><cac:Price><cbc:PriceAmount currencyID='EUR'>%s</cbc:PriceAmount></cac:Price></cac:InvoiceLine>"))
    line = line.otherwise(cell("<LineItem><Quantity>%s</Quantity><UnitPrice>%s</UnitPrice></LineItem>"))
    whole = l.groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "").alias("lines"))
    paper = F.when(r == 0, F.format_string("<?xml version='1.0'?><rsm:CrossIndustryInvoice xmlns:rsm='a' xmlns:ram='b'><rsm:ExchangedDocument><ram:ID schemeID='x'>%d</ram:ID></rsm:ExchangedDocument><rsm:SupplyChainTradeTransaction>%s<ram:ApplicableHeaderTradeSettlement><ram:SpecifiedTradeSettlementHeaderMonetarySummation><ram:GrandTotalAmount>1.5</ram:GrandTotalAmount></ram:SpecifiedTradeSettlementHeaderMonetarySummation></ram:ApplicableHeaderTradeSettlement></rsm:SupplyChainTradeTransaction></rsm:CrossIndustryInvoice>", "l_orderkey", "lines"))
    paper = paper.when(r == 1, F.format_string("<Invoice xmlns:cbc='a' xmlns:cac='b'><cbc:ID>%d</cbc:ID><cac:LegalMonetaryTotal><cbc:TaxInclusiveAmount>2</cbc:TaxInclusiveAmount></cac:LegalMonetaryTotal>%s</Invoice>", "l_orderkey", "lines"))
    paper = paper.when(r == 2, F.format_string("<Invoice><InvoiceNumber>%d</InvoiceNumber><TotalAmount>3</TotalAmount><LineItems>%s</LineItems></Invoice>", "l_orderkey", "lines")).otherwise("<Invoice><ID> </ID></Invoice>")
    papers = staged(whole.select("l_orderkey", paper.alias("xml")), "invoice-papers")
    found = B.invoices(papers, "l_orderkey", "xml")
    heads = found.groupBy("shape").agg(F.count("*").alias("invoices"), F.count("total").alias("with_total"))
    sums = B.invoice_lines(found.select("key", F.col("shape").alias("invoice_id"), "lines")).groupBy(F.col("invoice_id").alias("shape")).agg(F.count("*").alias("lines"), F.sum("quantity").cast("double").alias("quantity"), F.sum("net_price").cast("double").alias("price"))
    return heads.join(sums, "shape").select("shape", "invoices", "lines", "quantity", "price", "with_total")


@query("""
with m as (select date_trunc('month', o_orderdate) as s, count(*) as n from orders where month(o_orderdate) % 3 <> 0 group by 1)
select (g.s + interval 1 month - interval 1 day)::timestamp as bin, coalesce(n, 0)::double as value from (select unnest(generate_series((select min(s)::timestamp from m), (select max(s)::timestamp from m), interval 1 month)) as s) g left join m using (s)
""")
def resample_empty_months(t):
    return N.resample(t("orders").where("month(o_orderdate) % 3 <> 0"), "o_orderdate", "o_totalprice", "M", "count")
