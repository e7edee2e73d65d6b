"""Queries over file placement, logs, tags, observers, ranked search and further tests, with their SQL.

File names are made of the keys of the given tables, by one expression that Spark and SQL both take.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakelens.operators import filing as P
from lakelens.operators import inference as I
from lakelens.operators import records as L
from lakelens.operators import search as X
from lakelens.plans.registry import index_of, query, rounded


def _pick(key: str, values: list[str]) -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


_STEMS = ["raw", "clean_scan", "output", "Invoice_paid", "rechnung_vendor", "bill", "inv_offen", "Receipt_2019", "steuer", "agreement", "payroll_1998", "ethics", "citation", "manuscript", "accepted", "photo", "table", "notes", "lab_image", "design memo", "layout", "guideline", "yearly_report"]
_ENDS = [".csv", ".json.gz", ".ipynb", ".py", ".PNG", ".db", ".pdf", ".pptx", ".md", ".tex", "", ".key", ".mp4", ".dwg", ".sh", ".log", ".docx", ".json"]
NAME = f"concat({_pick('o_orderkey', _STEMS)}, '_', cast(o_custkey as string), {_pick('o_custkey', _ENDS)})"
PATH = f"concat('in/', o_orderpriority, '/', {NAME})"
_FILES = f"(select o_orderkey as id, {PATH} as path, lower({NAME}) as n, case when lower({NAME}) like '%.json.gz' then 'json.gz' else regexp_extract(lower({NAME}), '[^/.]\\.([^./]+)$', 1) end as e, {NAME} as name from orders)"


def _files(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), F.expr(PATH).alias("path"))


def _placed(cases: str) -> str:
    return f"select id, path, concat({cases}, '/', name) as destination from {_FILES}"


def _has(key: str) -> str:
    return f"regexp_matches(n, '{'|'.join(P.WORDS[key])}')"


def _is(key: str) -> str:
    return "e in (" + ", ".join(f"'{x}'" for x in P.EXTENSIONS[key]) + ")"


@query(
    _placed(
        f"""case when {_has("data_raw")} or {_is("data")} then 'Data/Projects/p/Data/Raw' when {_has("data_processed")} then 'Data/Projects/p/Data/Processed' when {_has("data_output")} then 'Data/Projects/p/Data/Output'
        when {_is("notebook")} then 'Data/Projects/p/Notebooks' when {_is("script")} then 'Data/Projects/p/Scripts' when {_is("visual")} then 'Data/Projects/p/Visuals' when {_is("database")} then 'Data/Projects/p/Data' else 'Data/Archive' end"""
    )
)
def place_data(t):
    return P.placed(_files(t), "path", P.data_folder("path", "p"))


@query(_placed(f"""case when {_is("slide")} then 'Education/Slides' when {_is("document")} then 'Education/Documents' else 'Education/Archive' end"""))
def place_education(t):
    return P.placed(_files(t), "path", P.education_folder("path"))


_YEAR = "coalesce(nullif(regexp_extract(n, '(19|20)\\d{2}', 0), ''), '2024')"


@query(
    _placed(
        f"""case when {_has("payroll")} then 'Business/Admin/HR/Payroll/' || {_YEAR} when {_has("tax")} then 'Business/Finance/Taxes/' || {_YEAR} when {_has("receipt")} then 'Business/Receipts/Expenses/' || {_YEAR}
        when {_has("invoice")} then 'Business/Invoices/' || case when {_has("incoming")} then 'Incoming/' when {_has("paid")} then 'Outgoing/Paid/' when {_has("overdue")} then 'Outgoing/Overdue/' else 'Outgoing/Unpaid/' end || {_YEAR}
        when {_has("contract")} then 'Business/Contracts/Employees' else 'Business/Archive' end"""
    )
)
def place_business(t):
    return P.placed(_files(t), "path", P.business_folder("path", 2024, employer=True))


@query(
    _placed(
        f"""'Research/' || case when {_has("admin")} then 'Admin' when {_has("reference")} then case when e = 'pdf' then 'References/PDFs' else 'References' end when {_is("presentation")} then 'Presentations' when {_is("note")} then 'Notes'
        when {_is("research_script")} then 'Data/Results' when {_is("research_data")} then 'Data/' || case when {_has("raw")} then 'Raw' when {_has("clean")} then 'Cleaned' when {_has("result")} then 'Results' else 'Raw' end
        when {_is("paper")} then 'Papers/' || case when {_has("published")} then 'Published' when {_has("draft")} then 'Drafts' else 'Submitted' end else 'Admin' end"""
    )
)
def place_research(t):
    return P.placed(_files(t), "path", P.research_folder("path"))


@query(
    _placed(
        f"""'Engineering/' || case when {_is("cad")} then 'CAD' when {_is("simulation")} or {_has("simulation")} then 'Projects/Simulation' when {_is("calculation")} or {_has("calculation")} then 'Projects/Calculations' when {_has("standard")} then 'Standards'
        when {_has("drawing")} then 'Drawings' when {_is("image")} or {_has("site_photo")} then 'Photos' when {_is("report")} or {_has("report")} then 'Projects/Reports' when {_has("design")} then 'Projects/Design' else 'Archive' end"""
    )
)
def place_engineering(t):
    return P.placed(_files(t), "path", P.engineering_folder("path"))


@query(
    _placed(
        f"""'Health/' || case when id % 2 = 0 then 'Patients/p' || id || '/' else '' end || case when contains(n, 'report') then 'Reports' when {_is("scan")} or contains(n, 'image') then 'Imaging' when contains(n, 'lab') then 'Lab'
        when contains(n, 'admin') then 'Admin' when contains(n, 'guideline') then 'Guidelines' when id % 2 = 0 and not regexp_matches(n, '[^/.]\\.(txt|pdf|docx|md)$') then 'unsorted' else 'Archive' end"""
    )
)
def place_health(t):
    who = F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), F.col("id").cast("string")))
    return P.placed(_files(t), "path", P.health_folder("path", who))


@query(_placed(f"""'IT/' || case when {_is("it_script")} then 'Code/Scripts' when {_is("it_config")} then 'Configs' when {_is("it_manual")} then 'Docs/Manuals' when {_is("it_note")} then 'Docs/Notes' when {_is("it_log")} then 'Logs' else 'Resources' end"""))
def place_it(t):
    return P.placed(_files(t), "path", P.it_folder("path"))


@query(_placed(f"""case when {_is("image")} then 'Media/Shoots/2024-05-06-sea/00_RAW' when {_is("video")} then 'Media/Video' else 'Media/Archive' end"""))
def place_media(t):
    return P.placed(_files(t), "path", P.media_folder("path", "2024-05-06", "sea"))


@query("""
select doc_id, source, n_chars from (select *, count(*) over (partition by lower(source), n_chars) as a, count(*) over (partition by md5(text)) as b from documents) where a > 1 or (b > 1 and text is not null)
""")
def duplicate_files(t):
    d = t("documents").select("doc_id", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))
    return P.duplicate_files(d, "source", "n_chars", "digest").drop("digest")


@query("""
select lang, cast(sum(n) as bigint) as files, cast(sum(s) as bigint) as bytes, cast(sum(case when text is not null then n - 1 else 0 end) as bigint) as copies
from (select lang, text, count(*) as n, sum(n_chars) as s from documents group by 1, 2) group by 1
""")
def folder_summary(t):
    return P.folder_summary(t("documents").select("lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest")), "lang", "n_chars", "digest")


@query(f"select id, path, e as extension from {_FILES} order by e = '', e, lower(name), path")
def list_by_extension(t):
    return P.listed(_files(t).withColumn("modified", F.lit(0)), "extension", "path", "modified").select("id", "path", P.extension("path").alias("extension"))


@query("select 'Customer-' || lpad(cast(max(cast(regexp_extract(c_name, '^Customer-(\\d+)$', 1) as bigint)) + 1 as string), 4, '0') as next_id from (select 'Customer-' || c_custkey as c_name from customer)")
def next_entity_id(t):
    return P.next_entity_id(t("customer").select(F.concat(F.lit("Customer-"), F.col("c_custkey").cast("string")).alias("name")), "name", "Customer")


@query(f"select id, replace(replace('{{day}}_{{title}}.txt', '{{day}}', strftime(d, '%Y-%m-%d')), '{{title}}', coalesce(p, '')) as name from (select o_orderkey as id, cast(o_orderdate as date) as d, o_orderstatus as p from orders)")
def named_files(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), P.named("{day}_{title}.txt", {"day": F.col("o_orderdate").cast("date"), "title": "o_orderstatus"}).alias("name"))


_BACKUPS = "(select o_orderkey as archive, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as parent, first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as root, o_orderdate as made from orders)"


@query(f"with b as {_BACKUPS} select archive from b where root not in (select archive from b where parent is null order by made desc, archive desc limit 3)")
def rotation(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    b = t("orders").select(F.col("o_orderkey").alias("archive"), F.lag("o_orderkey").over(w).alias("parent"), F.col("o_orderdate").alias("made"))
    return P.rotation(b, "archive", "parent", "made")


@query("""
select m.o_orderkey, case when p.k is null then 'missing' else 'mismatch' end as problem from orders m left join (select o_orderkey as k, case when o_orderkey % 5 = 0 then 'x' else o_orderstatus end as s from orders where o_orderkey % 7 <> 0) p on k = o_orderkey
where p.k is null or (o_orderkey % 3 > 0 and s is distinct from o_orderstatus)
""")
def verify_archive(t):
    m = t("orders").select("o_orderkey", "o_orderstatus")
    payload = m.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderstatus")))
    listed = m.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")))
    return P.verification(listed, payload, "o_orderkey", "o_orderstatus")


@query("""
with b as (select o_custkey, o_orderkey, o_orderdate, o_orderkey % 4 = 0 as f from orders where o_orderkey % 3 <> 0), l as (select o_custkey, max((o_orderdate, o_orderkey)) as top from b where f group by 1),
i as (select b.o_custkey, max((o_orderdate, o_orderkey)) as inc from b join l on b.o_custkey = l.o_custkey where not f and o_orderdate >= top[1] group by 1)
select l.o_custkey, coalesce(inc[2], top[2]) as base from l left join i on l.o_custkey = i.o_custkey
""")
def incremental_base(t):
    b = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 4 == 0, "full").otherwise("incremental").alias("kind"), (F.col("o_orderkey") % 3 != 0).alias("there"))
    return P.incremental_base(b, "o_custkey", "o_orderkey", "kind", "o_orderdate", "there")


@query("""
select o_orderkey, case when o_orderkey % 4 = 0 then '' else 'erstellt von: team ' || (o_custkey % 9) || '; ' end || 'kunde: ' || case when o_custkey % 3 = 0 then 'house ' || o_custkey else lower(o_orderpriority) end || '; patch: p' || (o_custkey % 50) || '.1' || case when o_custkey % 5 = 0 then '; status: ' || lower(o_orderstatus) || lower(o_orderstatus) else '' end as tags from orders
""")
def virtual_tags_with_metadata(t):
    meta = F.expr("map('KUNDE', case when o_custkey % 3 = 0 then concat('House, ', o_custkey) when o_custkey % 3 = 1 then ' .' end, 'Status', case when o_custkey % 5 = 0 then repeat(o_orderstatus, 2) else o_orderstatus end)")
    v = L.virtual_tags(F.expr(_HEADER), meta)
    return t("orders").select("o_orderkey", F.array_join(v, "; ").alias("tags"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def unreferenced(t):
    return P.unreferenced(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


_LINE = f"case when o_orderkey % 11 = 0 then concat('docs/x[', cast(o_orderkey % 5 as string), ']/', {NAME}) else concat('[', cast(cast(o_orderdate as date) as string), 'T08:15:30] /docs/', case when o_orderkey % 3 = 0 then '' else '2023/04/' end, o_orderpriority, '//', {NAME}) end"


@query(f"""
with p as (select id, regexp_replace(trim(case when contains(line, '] ') then regexp_extract(line, '([^\\]]*)$', 1) else line end), '[\\\\/]+', '/', 'g') as path, try_cast(nullif(replace(regexp_extract(line, '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}', 0), 'T', ' '), '') as timestamp) as ts
 from (select o_orderkey as id, {_LINE} as line from orders)), s as (select *, string_split(path, '/') as a from p)
select id, ts, path, a[-1] as file, lower(regexp_extract(a[-1], '\\.([^.]*)$', 1)) as extension, case when len(a) >= 5 and regexp_matches(a[-4], '^\\d{{4}}$') and regexp_matches(a[-3], '^\\d+$') then a[-4] end as year,
 case when len(a) >= 5 and regexp_matches(a[-4], '^\\d{{4}}$') and regexp_matches(a[-3], '^\\d+$') then a[-3] end as month, case when len(a) >= 5 and regexp_matches(a[-4], '^\\d{{4}}$') and regexp_matches(a[-3], '^\\d+$') then a[-2] end as customer from s
""")
def log_entries(t):
    return L.log_entries(t("orders").select(F.col("o_orderkey").alias("id"), F.expr(_LINE).alias("line")), "line").drop("line")


@query("select case when o_orderkey % 3 = 0 or o_orderkey % 11 = 0 then 'UNKNOWN' else o_orderpriority end as customer, count(*) as n from orders group by 1 order by n desc, customer limit 20")
def log_customers(t):
    x = L.log_entries(t("orders").select(F.lit("log").alias("log"), F.expr(_LINE).alias("line")), "line")
    return L.log_summary(x, "log")["customers"]


@query("select event_id, event_type from events where cast(ts as date) >= date '2024-01-15' - 10")
def log_retention(t):
    return L.retained(t("events"), "ts", 10, "2024-01-15").select("event_id", "event_type")


_HEADER = "concat('Kunde: ', o_orderpriority, chr(10), case when o_orderkey % 4 = 0 then '' else concat('Erstellt von:  Team ', cast(o_custkey % 9 as string), ' .', chr(10)) end, 'patch: p', cast(o_custkey % 50 as string), '.1')"


@query("""
select o_orderkey, 'kunde: ' || lower(o_orderpriority) as kunde, case when o_orderkey % 4 = 0 then null else 'erstellt von: team ' || (o_custkey % 9) end as made_by, 'patch: p' || (o_custkey % 50) || '.1' as patch, case when o_orderkey % 4 = 0 then 2 else 3 end as tags from orders
""")
def virtual_tags(t):
    x = t("orders").select("o_orderkey", L.virtual_tags(F.expr(_HEADER)).alias("v"))
    first = lambda start: F.get(F.filter("v", lambda s: s.startswith(start)), 0)
    return x.select("o_orderkey", first("kunde").alias("kunde"), first("erstellt von").alias("made_by"), first("patch").alias("patch"), F.size("v").alias("tags"))


@query("select o_orderkey, o_orderpriority as author, cast(o_totalprice as double) as width, 2 as technical from orders")
def metadata_tiers(t):
    m = F.create_map(F.lit("Author"), F.col("o_orderpriority"), F.lit("width"), F.col("o_totalprice").cast("string"), F.lit("format"), F.lit("png"))
    x = t("orders").select("o_orderkey", *L.metadata_tiers(m))
    return x.select("o_orderkey", F.col("semantic")["Author"].alias("author"), F.col("numbers")["width"].alias("width"), F.size("technical").alias("technical"))


@query("select o_orderkey, o_orderstatus as status, cast(o_custkey as string) as cust, 2 as pairs from orders")
def query_pairs(t):
    q = F.expr("concat('Status:x cust:', cast(o_custkey as string), ' word status:', o_orderstatus)")
    x = t("orders").select("o_orderkey", L.query_pairs(q).alias("m"))
    return x.select("o_orderkey", F.col("m")["status"].alias("status"), F.col("m")["cust"].alias("cust"), F.size("m").alias("pairs"))


@query("select o_orderkey, cast(cast(o_orderdate as date) as string) as iso, strftime(o_orderdate, '%d.%m.%Y') as german, 2 as n from orders")
def dates_in_text(t):
    x = t("orders").select("o_orderkey", L.dates_in(F.concat(F.lit("on "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" or "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("d"))
    return x.select("o_orderkey", F.col("d")[0].alias("iso"), F.col("d")[1].alias("german"), F.size("d").alias("n"))


@query("select c_custkey, c_name as patient_name, '1980-02-03' as dob, '12 ' || c_mktsegment || ' Road' as address, 'R' || c_custkey as case_number from customer")
def health_fields(t):
    text = F.concat(F.lit("patient name: "), F.col("c_name"), F.lit("\r\nborn 1980-02-03\r\nAddress: 12 "), F.col("c_mktsegment"), F.lit(" Road\nRecord #: R"), F.col("c_custkey").cast("string"))
    return t("customer").select("c_custkey", *L.health_fields(text))


@query("""
select c_custkey, case c_custkey % 3 when 0 then 'P' || c_custkey when 1 then cast(c_custkey as string) end as identity, case c_custkey % 3 when 0 then 'scan' when 1 then 'pid-' || c_custkey else 'plain' end as entity_key from customer
""")
def file_identity(t):
    path = F.expr("case c_custkey % 3 when 0 then concat('/h/Patients/P', c_custkey, '/Scan.pdf') when 1 then concat('/h/PID-', c_custkey, '.txt') else '/h/plain.txt' end")
    return t("customer").select("c_custkey", *L.identity(path))


@query("select event_type, count(*) as n, cast(max(user_id) as bigint) as users from (select event_type, user_id from events) group by 1")
def event_summary(t):
    x = L.event_summary(t("events").withColumn("column", F.lit("value")), "event_type", "column")
    users = t("events").groupBy("event_type").agg(F.max("user_id").alias("users"))
    return x.drop("columns").join(F.broadcast(users), "event_type")


@query("select event_type, count(*) as runs, round(avg(value), 4) as avg_ms, cast(sum(user_id) as bigint) as events, count(*) filter (value > 200) as errors from events group by 1")
def observer_metrics(t):
    return rounded(L.observer_metrics(t("events"), "event_type", "value", "user_id", F.col("value") > 200), 4)


@query("select event_id from events where not coalesce((user_id = 3 and event_type in ('error', 'click')) or (user_id = 5 and event_type in ('view')), false)")
def wanted_events(t):
    return L.wanted_events(t("events"), "user_id", "event_type", {"3": ["error", "click"], "5": ["view"]}).select("event_id")


@query("select event_id, ts, event_type from events where user_id = 13 order by ts")
def audit_listing(t):
    return L.audit(t("events"), "user_id", "13", "ts").select("event_id", "ts", "event_type")


@query("""select user_id, arg_min(event_type, ts) as "first", arg_max(event_type, ts) as "last" from events group by 1""")
def first_and_last(t):
    return L.first_and_last(t("events"), "user_id", "ts", "event_type")


@query(r"select token, count(*) as n from (select unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) as token from documents) where token <> '' group by 1 order by n desc, token limit 50")
def token_distribution(t):
    return L.token_distribution(t("documents"), "text")


@query("select source, count(text) as texts, cast(sum(length(text)) as bigint) as chars, round(avg(length(text)), 6) as mean_chars from documents group by 1")
def text_volume(t):
    return rounded(L.text_volume(t("documents"), "text", "source"))


@query("select 'k' || o_orderkey as cache_key, o_totalprice as timestamp, o_orderpriority as path, o_orderstatus as snippet from orders")
def search_cache_rows(t):
    r = F.array(F.struct(F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("snippet"), F.array(F.lit("t")).alias("tags")))
    cache = F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))), F.array(F.struct(F.col("o_totalprice").alias("timestamp"), r.alias("results")))))
    return t("orders").select(F.inline(L.cache_rows(cache))).drop("tags")


@query("select page_id, url from pages where contains(lower(url || ' ' || html), 'footer>')")
def saved_results(t):
    return L.saved_matches(t("pages"), "Footer>", ["url", "html"]).select("page_id", "url")


@query(r"""
with s as (select doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) as s from documents where text is not null),
p as (select doc_id, s, list_position(list_transform(s, lambda x: contains(lower(x), 'the')), true) as i from s) select doc_id, array_to_string(s[greatest(i - 1, 1):i + 1], ' ') as snippet from p where i > 0
""")
def sentence_snippets(t):
    return t("documents").select("doc_id", L.sentence_snippet("text", "the", 1).alias("snippet")).where("snippet is not null")


@query("select c_custkey, 'uber-' || lower(replace(c_name, '#', '-')) as slug from customer")
def slugs(t):
    return t("customer").select("c_custkey", L.slug(F.concat(F.lit(" Über "), F.replace("c_name", F.lit("#"), F.lit(" — ")))).alias("slug"))


@query("select 'orders' as tbl, 'o_orderdate' as col union all select 'events', 'ts' union all select 'text', 'made_day'")
def date_columns(t):
    o, e = t("orders"), t("events")
    text = o.select(F.col("o_orderstatus").alias("state"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("made_day"))
    return o.sparkSession.createDataFrame([("orders", L.date_column(o)), ("events", L.date_column(e)), ("text", L.date_column(text))], "tbl string, col string")


@query("select c_custkey as k, c_name as name, c_mktsegment as segment, null as comment from customer union all select s_suppkey, s_name, null, 's' from supplier")
def union_missing(t):
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("s").alias("comment"))
    return L.union_all([c, s])


@query("select o_custkey as k from orders union select c_custkey from customer union select s_suppkey from supplier")
def known_paths(t):
    return L.known_paths([t("orders").select(F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k")), t("supplier").select(F.col("s_suppkey").alias("k"))], "k")


@query("with x as (select value as a, lag(value) over (partition by user_id order by ts, event_id) as b from events) select round(corr(a, b), 6) as r, count(*) filter (a is not null and b is not null) as n from x")
def lag_correlation(t):
    return rounded(I.lag_correlation(t("events"), "value", "value", "user_id", ["ts", "event_id"]).select("r", "n"))


@query("""
with g as (select o_orderstatus = 'F' as g, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) / count(*) as v from orders group by 1), p as (select a.m - b.m as d, a.v as va, b.v as vb, a.n as na, b.n as nb from g a, g b where not a.g and b.g)
select round(d, 4) as diff, round(sqrt(va + vb), 4) as se, round((va + vb) ^ 2 / (va ^ 2 / (na - 1) + vb ^ 2 / (nb - 1)), 4) as df from p
""")
def mean_difference(t):
    x = t("orders").select((F.col("o_orderstatus") == "F").alias("g"), "o_totalprice")
    return rounded(I.mean_difference(x, "o_totalprice", "g").select("diff", "se", "df"), 4)


@query("""
with g as (select o_orderpriority as g, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1), w as (select sum((n - 1) * v) / (sum(n) - count(*)) as mse from g)
select a.g as a, b.g as b, round(b.m - a.m, 4) as diff, round(abs(b.m - a.m) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 6) as q from g a, g b, w where a.g < b.g
""")
def post_hoc(t):
    return I.post_hoc(t("orders"), "o_totalprice", "o_orderpriority").select("a", "b", F.round("diff", 4).alias("diff"), F.round("q", 6).alias("q"))


@query("select count(value) as n, round(avg(value), 6) as mean, true as holds from events")
def bootstrap_mean(t):
    return I.bootstrap_mean(t("events"), "value", "event_id", 500).select("n", F.round("mean", 6).alias("mean"), ((F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))).alias("holds"))


_HITS = r"""with x as (select doc_id, source, lang, text, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as t from documents where text is not null),
y as (select *, len(t) as len, cast(len(list_filter(t, lambda w: w = 'the')) as bigint) as u from x), s as (select count(*) as n, avg(len) as avglen, count(*) filter (u > 0) as d from y),
h as (select *, round(greatest(1e-6, ln((n - d + 0.5) / (d + 0.5))) * u * 2.2 / (u + 1.2 * (0.25 + 0.75 * len / avglen)), 6) as score from y, s where u > 0)"""


@query(_HITS + r""", w as (select doc_id, regexp_split_to_array(text, '\s+') as p from h), i as (select doc_id, unnest(list_filter(range(1, len(p) + 1), lambda i: contains(lower(p[i]), 'the'))) as i from w),
g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 17 then 0 else 1 end as new from i), r as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from g),
b as (select doc_id, run, greatest(min(i) - 8, 1) as a, max(i) + 8 as b from r group by all), k as (select doc_id, string_agg(trim(array_to_string(p[a:b], ' ')), ' ... ' order by run) as snippet from b join w using (doc_id) where run <= 3 group by doc_id)
select doc_id, score, snippet from h left join k using (doc_id) where source = 'src1' and lang = 'en' order by score desc, doc_id""")
def search_filtered(t):
    d = t("documents")
    return rounded(X.ranked(d, "doc_id", "text", "the", (F.col("source") == "src1") & (F.col("lang") == "en"), index=index_of(d)).select("doc_id", "score", "snippet"))


@query(_HITS + " select doc_id, score, quality from h join labels using (doc_id) where quality = 1 order by lower(source), score desc, doc_id")
def search_with_metadata(t):
    x = X.ranked(t("documents"), "doc_id", "text", "the", F.col("quality") == 1, t("labels"), "path", path="source", index=index_of(t("documents")))
    return rounded(x.select("doc_id", "score", "quality"))
