"""Where files belong: placement rules, duplicates, names, backups and their checks, all as column expressions and joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.operators.observe import chains

# Words of file names, extensions and folders of the placement profiles.
WORDS = {
    "data_raw": ["raw", "dirty", "unprocessed"],
    "data_processed": ["clean", "processed", "normalized"],
    "data_output": ["output", "result", "final"],
    "invoice": ["invoice", "inv", "rechnung", "bill", "facture"],
    "paid": ["paid", "bezahlt", "settled"],
    "overdue": ["overdue", "offen", "unpaid"],
    "incoming": ["incoming", "supplier", "vendor", "lieferant"],
    "receipt": ["receipt", "beleg", "quittung"],
    "tax": ["tax", "vat", "ust", "mwst", "steuer"],
    "contract": ["contract", "agreement", "nda"],
    "payroll": ["payroll", "salary", "lohn", "gehalt"],
    "raw": ["raw", "source", "original", "instrument"],
    "clean": ["clean", "processed", "normalized", "derived"],
    "result": ["result", "results", "analysis", "output", "figure", "table"],
    "reference": ["reference", "citation", "bibliography", "bibtex", "zotero"],
    "draft": ["draft", "manuscript", "preprint"],
    "published": ["published", "accepted", "final"],
    "admin": ["ethics", "irb", "grant", "budget", "admin", "approval"],
    "simulation": ["simulation", "sim", "fea", "cfd", "analysis", "model"],
    "calculation": ["calc", "calculation", "spreadsheet", "load", "stress", "tolerance"],
    "standard": ["standard", "specification", "code", "iso", "din", "astm"],
    "drawing": ["drawing", "drawings", "schematic", "layout"],
    "site_photo": ["photo", "site", "inspection", "field"],
    "report": ["report", "summary", "review", "memo"],
    "design": ["design", "concept", "spec", "requirement"],
}
EXTENSIONS = {
    "notebook": ["ipynb"],
    "script": ["py", "r", "sql"],
    "visual": ["jpg", "jpeg", "png", "svg"],
    "data": ["csv", "parquet", "xlsx", "json", "json.gz"],
    "database": ["db", "sqlite"],
    "document": ["pdf", "txt", "md", "docx", "pptx"],
    "slide": ["pptx", "key"],
    "paper": ["pdf", "doc", "docx", "tex", "rtf"],
    "research_data": ["csv", "tsv", "xlsx", "json", "json.gz", "parquet", "db", "sqlite"],
    "note": ["md", "txt", "rst"],
    "presentation": ["ppt", "pptx", "key"],
    "research_script": ["py", "r", "jl", "m", "ipynb", "sql"],
    "cad": ["dwg", "dxf", "step", "stp", "iges", "igs", "sldprt", "sldasm", "f3d"],
    "simulation": ["fem", "inp", "odb", "msh", "sim", "ans", "cfd"],
    "calculation": ["xlsx", "xls", "csv", "m", "py", "ipynb", "r"],
    "report": ["pdf", "doc", "docx", "md", "txt"],
    "image": ["jpg", "jpeg", "png", "tiff", "bmp"],
    "scan": ["jpg", "jpeg", "png", "dcm"],
    "video": ["mp4", "avi", "mov", "mkv"],
    "it_script": ["py", "bat", "ps1", "sh"],
    "it_config": ["cfg", "ini", "yaml", "yml", "json"],
    "it_manual": ["pdf", "docx"],
    "it_note": ["md", "txt"],
    "it_log": ["log"],
}


def extension(name: str | Column) -> Column:
    """Lower-case extension without the dot; json.gz counts as one; empty if there is none."""
    low = F.lower(name)
    return F.when(low.endswith(".json.gz"), "json.gz").otherwise(F.regexp_extract(low, r"[^/.]\.([^./]+)$", 1))


def file_name(path: str | Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def first_of(rules: Sequence[tuple[Column, str | Column]], otherwise: str | Column) -> Column:
    """The value of the first rule that holds."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.coalesce(*[F.when(holds, as_column(v)) for holds, v in rules], as_column(otherwise))


def _tests(path: str | Column) -> tuple[Callable[[str], Column], Callable[[str], Column], Column]:
    low, ext = F.lower(file_name(path)), extension(path)
    return (lambda key: low.rlike("|".join(WORDS[key]))), (lambda key: ext.isin(*EXTENSIONS[key])), low


def data_folder(path: str | Column, project: str = "Unnamed_Project") -> Column:
    """Raw comes first and takes every data extension, whatever the name says."""
    word, kind, _ = _tests(path)
    base = f"Data/Projects/{project}"
    return first_of(
        [
            (word("data_raw") | kind("data"), f"{base}/Data/Raw"),
            (word("data_processed"), f"{base}/Data/Processed"),
            (word("data_output"), f"{base}/Data/Output"),
            (kind("notebook"), f"{base}/Notebooks"),
            (kind("script"), f"{base}/Scripts"),
            (kind("visual"), f"{base}/Visuals"),
            (kind("database"), f"{base}/Data"),
        ],
        "Data/Archive",
    )


def education_folder(path: str | Column) -> Column:
    _, kind, _ = _tests(path)
    return first_of([(kind("slide"), "Education/Slides"), (kind("document"), "Education/Documents")], "Education/Archive")


def business_folder(path: str | Column, year: int | Column, employer: bool = False, project: str | None = None) -> Column:
    """`year` stands in where the name has none of 19xx or 20xx."""
    word, _, low = _tests(path)
    in_name = F.regexp_extract(low, r"(19|20)\d{2}", 0)
    when = F.when(in_name != "", in_name).otherwise(F.lit(year).cast("string"))
    at = lambda folder: F.concat(F.lit(f"Business/{folder}/"), when)
    rules = [(word("payroll"), at("Admin/HR/Payroll"))] if employer else []
    rules += [
        (word("tax"), at("Finance/Taxes")),
        (word("receipt"), at("Receipts/Expenses")),
        (word("invoice") & word("incoming"), at("Invoices/Incoming")),
        (word("invoice") & word("paid"), at("Invoices/Outgoing/Paid")),
        (word("invoice") & word("overdue"), at("Invoices/Outgoing/Overdue")),
        (word("invoice"), at("Invoices/Outgoing/Unpaid")),
        (word("contract"), f"Business/Contracts/{'Employees' if employer else 'Customers'}"),
    ]
    return first_of(rules, f"Business/Projects/Active/{project}" if project else "Business/Archive")


def research_folder(path: str | Column) -> Column:
    word, kind, _ = _tests(path)
    data = first_of([(word("raw"), "Raw"), (word("clean"), "Cleaned"), (word("result"), "Results")], "Raw")
    paper = first_of([(word("published"), "Published"), (word("draft"), "Drafts")], "Submitted")
    tail = first_of(
        [
            (word("admin"), "Admin"),
            (word("reference"), F.when(extension(path) == "pdf", "References/PDFs").otherwise("References")),
            (kind("presentation"), "Presentations"),
            (kind("note"), "Notes"),
            (kind("research_script"), "Data/Results"),
            (kind("research_data"), F.concat(F.lit("Data/"), data)),
            (kind("paper"), F.concat(F.lit("Papers/"), paper)),
        ],
        "Admin",
    )
    return F.concat(F.lit("Research/"), tail)


def engineering_folder(path: str | Column) -> Column:
    word, kind, _ = _tests(path)
    rules = [
        (kind("cad"), "CAD"),
        (kind("simulation") | word("simulation"), "Projects/Simulation"),
        (kind("calculation") | word("calculation"), "Projects/Calculations"),
        (word("standard"), "Standards"),
        (word("drawing"), "Drawings"),
        (kind("image") | word("site_photo"), "Photos"),
        (kind("report") | word("report"), "Projects/Reports"),
        (word("design"), "Projects/Design"),
    ]
    return F.concat(F.lit("Engineering/"), first_of(rules, "Archive"))


def health_folder(path: str | Column, patient: str | Column | None = None) -> Column:
    """Below the patient's own folder where `patient` is not null; a patient's files that no rule takes stay unsorted there unless they are documents."""
    _, kind, low = _tests(path)
    has = lambda w: F.contains(low, F.lit(w))
    rules = [(has("report"), "Reports"), (kind("scan") | has("image"), "Imaging"), (has("lab"), "Lab"), (has("admin"), "Admin"), (has("guideline"), "Guidelines")]
    who = F.lit(None).cast("string") if patient is None else F.col(patient) if isinstance(patient, str) else patient
    rest = F.when(who.isNull() | extension(path).isin("txt", "pdf", "docx", "md"), "Archive").otherwise("unsorted")
    return F.concat_ws("/", F.lit("Health"), F.concat(F.lit("Patients/"), who), first_of(rules, rest))


def it_folder(path: str | Column) -> Column:
    _, kind, _ = _tests(path)
    rules = [(kind("it_script"), "Code/Scripts"), (kind("it_config"), "Configs"), (kind("it_manual"), "Docs/Manuals"), (kind("it_note"), "Docs/Notes"), (kind("it_log"), "Logs")]
    return F.concat(F.lit("IT/"), first_of(rules, "Resources"))


def media_folder(path: str | Column, day: str | Column, shoot: str | None = None) -> Column:
    """Images go to the shoot of the day, named if `shoot` is given."""
    _, kind, _ = _tests(path)
    date = F.date_format(F.lit(day).cast("date") if isinstance(day, str) else day, "yyyy-MM-dd")
    folder = F.concat(F.lit("Media/Shoots/"), F.concat_ws("-", date, F.lit(shoot)), F.lit("/00_RAW"))
    return first_of([(kind("image"), folder), (kind("video"), "Media/Video")], "Media/Archive")


def placed(files: DataFrame, path: str, folder: Column) -> DataFrame:
    """Each file with its destination: the folder and its own name."""
    return files.withColumn("destination", F.concat(folder, F.lit("/"), file_name(path)))


def duplicate_files(files: DataFrame, name: str, size: str, digest: str) -> DataFrame:
    """Rows that share their lower-cased name and size, or their content's digest, with another row.

    A null size equals another; a null digest (a file that cannot be read) equals none. Repeats are counted first and
    met again by a join, so a file with very many copies is not one window.
    """
    x = files.withColumns({"_name": F.lower(name), "_size": F.col(size), "_digest": F.col(digest)})
    several = lambda keys, mark: x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias(mark))
    for i, keys in enumerate((["_name", "_size"], ["_digest"])):
        x_, y = x.alias("x"), several(keys, f"_m{i}").alias("y")
        equal = F.expr(" and ".join(f"x.{k} {'=' if k == '_digest' else '<=>'} y.{k}" for k in keys))
        x = x_.join(y, equal, "left").select("x.*", f"y._m{i}")
    return x.where("_m0 or _m1").drop("_name", "_size", "_digest", "_m0", "_m1")


def folder_summary(files: DataFrame, category: str, size: str, digest: str) -> DataFrame:
    """Files, bytes and copies (files beyond the first of each digest) of each category."""
    per = files.groupBy(category, digest).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_s"))
    return per.groupBy(category).agg(F.sum("_n").alias("files"), F.sum("_s").alias("bytes"), F.sum(F.when(F.col(digest).isNotNull(), F.col("_n") - 1).otherwise(0)).alias("copies"))


def listed(files: DataFrame, by: str, path: str, modified: str) -> DataFrame:
    """A listing by date (newest first), name, or extension (files without one last)."""
    name, ext = F.lower(file_name(path)), extension(path)
    order = {"date": [F.desc_nulls_last(modified), name], "name": [name], "extension": [ext == "", ext, name]}
    if by not in order:
        raise ValueError(f"a listing is sorted by one of {sorted(order)}")
    return files.orderBy(*order[by], path)


def next_entity_id(folders: DataFrame, name: str, prefix: str, width: int = 4) -> DataFrame:
    """One row: the id after the largest number among folders named prefix-number."""
    number = F.expr(f"try_cast(regexp_extract({name}, '^{prefix}-(\\\\d+)$', 1) as bigint)")
    top = F.coalesce(F.max(number), F.lit(0)) + 1
    return folders.agg(F.concat(F.lit(f"{prefix}-"), F.lpad(top.cast("string"), F.greatest(F.length(top.cast("string")), F.lit(width)), F.lit("0"))).alias("next_id"))


def named(pattern: str, fields: dict[str, str | Column]) -> Column:
    """The pattern with {field} replaced by the field's column, null as empty."""
    out = F.lit(pattern)
    for key, c in fields.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))
    return out


def rotation(backups: DataFrame, archive: str, parent: str, at: str, keep: int = 3) -> DataFrame:
    """Archives to delete: all full backups but the newest `keep`, and whatever stands on one of them."""
    fulls = backups.where(F.col(parent).isNull()).select(F.col(archive).alias("root"), at)
    kept = fulls.orderBy(F.desc_nulls_last(at), F.desc("root")).limit(keep)
    roots = chains(backups.sparkSession, backups, archive, parent).where("root is not null")
    return roots.join(F.broadcast(kept.select("root")), "root", "left_anti").select(F.col("key").alias(archive))


def verification(manifest: DataFrame, payload: DataFrame, path: str, digest: str, full: bool = True) -> DataFrame:
    """(path, problem): files of a full backup's manifest that the payload lacks, and files with another digest.

    A file whose digest the manifest does not give is not compared; an incremental payload may lack files.
    """
    x = manifest.select(path, F.col(digest).alias("_m")).join(payload.select(path, F.col(digest).alias("_p"), F.lit(True).alias("_has")), path, "left")
    lost = F.col("_has").isNull()
    problem = F.when(lost, F.when(F.lit(full), "missing")).when((F.col("_m") != "") & ~F.col("_m").eqNullSafe(F.col("_p")), "mismatch")
    return x.select(path, problem.alias("problem")).where("problem is not null")


def incremental_base(backups: DataFrame, by: str, archive: str, kind: str, at: str, exists: str) -> DataFrame:
    """What the next incremental stands on: the newest existing one not older than the newest existing full, else that full."""
    x = backups.where(F.col(exists))
    full = F.max(F.when(F.col(kind) == "full", F.struct(at, archive))).over(Window.partitionBy(by))
    x = x.withColumn("_full", full).where(F.col("_full").isNotNull())
    ok = (F.col(kind) == "incremental") & (F.col(at) >= F.col(f"_full.{at}"))
    y = x.groupBy(by).agg(F.max(F.when(ok, F.struct(at, archive))).alias("_i"), F.max("_full").alias("_full"))
    return y.select(by, F.coalesce(F.col(f"_i.{archive}"), F.col(f"_full.{archive}")).alias("base"))


def unreferenced(listing: DataFrame, registry: DataFrame, path: str) -> DataFrame:
    """Artifacts that no registry row names."""
    return listing.join(registry.select(path).where(F.col(path).isNotNull()).distinct(), path, "left_anti")
