"""Reads with fixed schemas: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify, ids, udfs
from ..functions.text import collapse, first_line, first_nonempty, or_empty, or_null, strip
from ..functions.values import choose_complete
from ..operators.packets import choose_abstract
from .tables import KeyedTable

SKIPPED_FOLDERS = (".git", ".obsidian", "node_modules", ".venv", "__pycache__")


def _schema(text: str, times: str = "", ints: str = "", flags: str = "", lists: str = "") -> T.StructType:
    kinds = ((text, T.StringType()), (times, T.TimestampType()), (ints, T.IntegerType()), (flags, T.BooleanType()), (lists, T.ArrayType(T.StringType())))
    return T.StructType([T.StructField(n, kind) for names, kind in kinds for n in names.split()])


MESSAGES = _schema("message_id thread_id alert_name subject from_address sent_at snippet raw_json", "imported_at")
ARTICLES = _schema("article_key paper_key domain message_id alert_name title authors publication_info snippet scholar_url article_url pdf_url format_label status", "created_at updated_at processed_at", "rank_in_email author_count score", "is_open_access", "reasons")
PAPERS = _schema("paper_key title canonical_url doi pmid workflow_state matched_content_path published_commit published_pr archived_source_path", "workflow_state_updated_at scraped_at matched_at drafted_at committed_at pr_opened_at merged_at archived_at created_at updated_at")
JOBS = _schema("article_key paper_key source_url canonical_source_url alert_name domain claim_policy state lease_owner run_id packet_path target_path branch commit_sha pr_url result_json error", "lease_expires_at next_run_at created_at updated_at started_at finished_at", "job_id attempt_count max_attempts")
EVENTS = _schema("from_state to_state detail_json", "created_at", "event_id job_id")
#: What a column gets that an older table doesn't have.
DEFAULTS = {"domain": "Natural Healing", "workflow_state": "discovered", "state": "queued", "claim_policy": "integrated", "attempt_count": 0, "max_attempts": 3, "is_open_access": False}


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in a schema: missing columns are added with their defaults, blank text in optional columns becomes null."""
    out = []
    for x in schema:
        c = F.col(x.name).cast(x.dataType) if x.name in df.columns else F.lit(None).cast(x.dataType)
        if x.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[x.name]).cast(x.dataType))
        elif isinstance(x.dataType, T.StringType):
            c = or_null(c)
        out.append(c.alias(x.name))
    return df.select(*out)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return migrate(spark.read.parquet(path), schema)


def body_text(data: Column | str) -> Column:
    """The text of a mail part: URL-safe base64, with or without its padding; bytes that are no UTF-8 become replacement characters."""
    plain = F.translate(or_empty(data), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Landed mail, one JSON message a line: ids, headers, html and subject."""
    raw = spark.read.text(path).withColumnRenamed("value", "raw_json")
    h = udfs.message_headers("raw_json")
    df = raw.withColumn("h", h)
    get = lambda k: F.element_at("h", F.lit(k))
    return df.select(F.get_json_object("raw_json", "$.id").alias("message_id"), F.get_json_object("raw_json", "$.threadId").alias("thread_id"), get("subject").alias("subject"), get("from").alias("from_address"), get("date").alias("sent_at"), F.get_json_object("raw_json", "$.snippet").alias("snippet"), "raw_json", udfs.message_html("raw_json").alias("html"))


def markdown_pages(spark: SparkSession, root: str) -> DataFrame:
    """path, title, stem, tags, tags_is_list, permalink, error, body, modified and size of all Markdown files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").format("binaryFile").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + "".join(c if c.isalnum() or c == "/" else "\\" + c for c in base), "")
    df = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    df = df.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))))
    return split_front_matter(df)


def split_front_matter(df: DataFrame) -> DataFrame:
    """df(path, text, …) with the fields of the front matter and the body."""
    front = r"(?s)^---\n(.*?)\n?[ \t]*---[ \t]*(?:\n|$)(.*)$"
    has = F.regexp_like("text", F.lit(front))
    df = df.withColumns({"m": F.when(has, udfs.front_matter(F.regexp_extract("text", front, 1))), "body": F.when(has, F.regexp_extract("text", front, 2)).otherwise(F.col("text")), "stem": F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)})
    return df.select(*[c for c in df.columns if c not in ("m", "text")], F.coalesce("m.title", "stem").alias("title"), F.coalesce("m.tags", F.array().cast("array<string>")).alias("tags"), "m.tags_is_list", "m.permalink", "m.error")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or whose time or size differ from the last scan; only these need reading again."""
    return now.join(before.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")


def rescan(stored: KeyedTable, now: DataFrame) -> DataFrame:
    """path, what (new, changed or gone) of the files of a scan against the last one that is stored, by time and size; and the scan is stored in its place.

    stored: a table by path with the columns of now, among them modified and size. Only the buckets of such files are written.
    """
    before = stored.read()
    b = before.select("path", F.col("modified").alias("__modified"), F.col("size").alias("__size"), F.lit(True).alias("__known"))
    found = now.withColumn("__here", F.lit(True)).join(b, "path", "full")
    same = F.col("modified").eqNullSafe(F.col("__modified")) & F.col("size").eqNullSafe(F.col("__size"))
    found = found.withColumn("what", F.when(F.col("__known").isNull(), "new").when(F.col("__here").isNull(), "gone").when(~same, "changed")).where("what is not null").drop("__here", "__known", "__modified", "__size")

    def how(current: DataFrame, changes: DataFrame) -> DataFrame:
        return current.join(changes.select("path"), "path", "left_anti").unionByName(changes.where("what <> 'gone'").drop("what"))

    stored.merge(found, how)
    return found.select("path", "what")


#: Pages of a PDF that are its preview, in which its DOI, abstract and title are looked for.
PREVIEW = 3


def pdf_packets(pages: DataFrame) -> DataFrame:
    """pages(source, page, text, meta_title, meta_author, meta_subject), a row for each page, as packets: source, url, title, authors, doi, abstract, keywords, preview, body_markdown, n_pages.

    Pages without text leave no trace; a document's pages come together, and their order is their number's.
    """
    clean = F.regexp_replace(F.regexp_replace(F.replace(F.replace(or_empty("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "[ \\t]+", " "), "\n{3,}", "\n\n")
    rows = pages.withColumn("text", strip(clean))
    first = lambda c: F.max(or_empty(c)).alias(c)
    of = rows.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"), *map(first, ("meta_title", "meta_author", "meta_subject")))
    whole = lambda xs: F.array_join(F.filter(F.transform(xs, lambda x: x["text"]), lambda t: t != ""), "\n\n")
    df = of.select("source", F.size("p").alias("n_pages"), whole(F.col("p")).alias("body_markdown"), whole(F.slice("p", 1, PREVIEW)).alias("preview"), *[collapse(c).alias(c) for c in ("meta_title", "meta_author", "meta_subject")])
    doi = ids.doi("meta_subject", "meta_title", "preview", "source", lower=False)
    stem = F.regexp_extract("source", r"([^/]+?)(?:\.[^./]*)?$", 1)
    df = pdf_text(df.withColumn("text", F.col("preview"))).drop("text")
    url = F.when(ids.valid_http_url("source"), F.col("source")).when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.col("source"))
    return df.select("source", url.alias("url"), first_nonempty("meta_title", first_line("preview"), stem).alias("title"), F.col("meta_author").alias("authors"), doi.alias("doi"), "abstract", "keywords", "preview", "body_markdown", "n_pages")


def pdf_text(df: DataFrame) -> DataFrame:
    """df(text) with abstract and keywords, each up to the next section's word."""
    stop = r"(?=\b(?:keywords?|introduction|background|methods?|materials|results?|discussion|conclusion|references)\b)"
    abstract = F.regexp_extract("text", r"(?is)\babstract\b[\s:.\-]*(.+?)" + stop, 1)
    keywords = F.regexp_extract("text", r"(?is)\bkeywords?\b[\s:.\-]*(.+?)(?=\n{2,}|\b(?:introduction|background|methods?|materials|results?|discussion|conclusion|references)\b)", 1)
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^[ .;]+|[ .;]+$", ""))
    return df.withColumns({"abstract": F.trim(F.regexp_replace(abstract, r"(?U)\s+", " ")), "keywords": clean(keywords)})


def html_packets(pages: DataFrame) -> DataFrame:
    """pages(url, html) as packets: what their meta values, title, heading and body say."""
    df = pages.withColumn("p", udfs.page_parts("html"))
    meta = lambda *names: F.concat(*[F.coalesce(F.element_at("p.metas", F.lit(n)), F.array().cast("array<string>")) for n in names])
    one = lambda *names: F.coalesce(F.try_element_at(F.filter(meta(*names), lambda x: x != ""), F.lit(1)), F.lit(""))
    title = choose_complete(F.concat(meta("citation_title", "dc.title", "og:title"), F.array("p.heading", "p.title")), 1000)
    abstract = choose_abstract([meta("citation_abstract", "dc.description.abstract"), F.array().cast("array<string>"), meta("og:description", "description")])
    doi = ids.doi(one("citation_doi", "dc.identifier"), F.col("url"), F.col("p.body"), lower=False)
    out = df.select("url", title.alias("title"), F.array_join(F.filter(meta("citation_author", "dc.creator"), lambda x: x != ""), ", ").alias("authors"), one("citation_journal_title", "prism.publicationname").alias("journal"), one("citation_publication_date", "citation_date", "dc.date").alias("pub_date"), F.array_join(meta("citation_keywords", "keywords"), "; ").alias("keywords"), abstract.alias("abstract"), doi.alias("doi"), F.col("p.body").alias("body_markdown"))
    none = F.array().cast("array<string>")
    kind = classify.study_type(F.col("title"), F.col("abstract"), none, none, F.col("body_markdown"))
    return out.withColumns({"study_type": kind, "pmid": ids.pmid("url"), "reference_url": first_nonempty(F.when(or_empty("doi") != "", F.concat(F.lit("https://doi.org/"), "doi")), F.col("url")), "retrieval_issues": classify.extraction_issues(F.col("title"), F.col("abstract"), F.col("body_markdown"))})
