"""What survives of a packet's metadata where registries know the same source: an ordered table of repairs, folded over each row.

A repair names a field, the registries whose first non-blank value it takes, and what must be wrong with the field as it is by then. The table is
read from top to bottom, so what one repair has filled the next one sees; `repairs` logs those that applied. Registries are joined by packet,
any number of them, with whatever fields they have; another one is another line of the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import collapse, first_nonempty, key, or_empty, overlap_ratio

FIELDS = ("title", "doi", "authors", "journal", "pub_date", "abstract")
#: What stands in a field for nothing, and signs of a page's text in a list of authors.
PLACEHOLDERS = {"authors": ("author", "authors", "author s", "authors and affiliations", "unknown", "n a"), "journal": ("journal", "ovid", "publisher", "source", "unknown", "n a"), "pub_date": ("date", "published", "unknown", "n a")}
POLLUTED = r"highlights •|abstract quercetin|author links open overlay"
MOST_AUTHORS, LEAST_ABSTRACT, BODY = 1200, 120, 5000
OPEN_HOST = "pmc.ncbi.nlm.nih.gov"
#: Share of common words of both titles below which a DOI may be another paper's.
SAME_TITLE = 0.75

Guard = Callable[[Column, Column], Column]


def missing(now: Column, new: Column) -> Column:
    return now == ""


def polluted(now: Column, new: Column) -> Column:
    return (F.length(now) > MOST_AUTHORS) | F.regexp_like(F.lower(now), F.lit(POLLUTED))


def truncated(now: Column, new: Column) -> Column:
    return now.endswith("…") | now.endswith("...") | ((F.length(now) < LEAST_ABSTRACT) & (F.length(new) > F.length(now)))


@dataclass(frozen=True)
class Repair:
    field: str
    sources: tuple[str, ...]
    guard: Guard
    log: str


def _fill(name: str, *sources: str) -> list[Repair]:
    return [Repair(name, (s,), missing, f"{name}:recovered_from_{s}") for s in sources]


#: In the order in which they apply.
LATTICE = (
    *_fill("doi", "crossref", "pubmed"),
    *_fill("title", "crossref", "pubmed"),
    *_fill("authors", "crossref", "pubmed"),
    Repair("authors", ("crossref", "pubmed"), polluted, "authors:replaced_polluted_from_external_metadata"),
    *_fill("journal", "crossref", "pubmed"),
    *_fill("pub_date", "crossref", "pubmed"),
    *_fill("abstract", "crossref"),
    Repair("abstract", ("crossref",), truncated, "abstract:recovered_from_crossref"),
)


def is_placeholder(name: str, x: Column) -> Column:
    """Whether a field says nothing: no letter or digit of ASCII, or a word for nothing."""
    text = key(collapse(F.coalesce(x, F.lit(""))))
    return (text == "") | text.isin(*PLACEHOLDERS[name])


def _of(df: DataFrame, name: str) -> Column:
    """A column that a registry or a packet may not have."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None)


def _registry(df: DataFrame, tag: str) -> DataFrame:
    values = {c: collapse(or_empty(_of(df, c).cast("string"))) for c in (*FIELDS, "pmid", "best_open_access_url")}
    values["doi"] = ids.doi(values["doi"], lower=False)
    is_open = F.coalesce(_of(df, "is_open_access").cast("boolean"), F.lit(False))
    return df.select("packet_id", F.struct(*[x.alias(c) for c, x in values.items()], is_open.alias("is_open_access")).alias(f"__{tag}")).dropDuplicates(["packet_id"])


def survive(packets: DataFrame, registries: dict[str, DataFrame], lattice: tuple[Repair, ...] = LATTICE) -> DataFrame:
    """packets(packet_id and any of FIELDS, url, requested_url, body_markdown, pmid, is_open_access, best_open_access_url), repaired from registries by packet_id.

    Adds repairs, doi_title_score and consistency (the DOI's own title differs), enrichment_sources, pmid, is_open_access, best_open_access_url.
    """
    df = packets
    for tag, rows in registries.items():
        df = df.join(_registry(rows, tag), "packet_id", "left")
    have = lambda tag, c: F.coalesce(F.col(f"__{tag}")[c], F.lit("")) if tag in registries else F.lit("")
    raw = {c: collapse(or_empty(_of(packets, c).cast("string"))) for c in (*FIELDS, "url", "requested_url", "pmid", "best_open_access_url")}
    body = F.substring(or_empty(_of(packets, "body_markdown").cast("string")), 1, BODY)
    now = {"doi": ids.doi(raw["doi"], raw["url"], raw["requested_url"], body, lower=False), "title": raw["title"], "abstract": raw["abstract"]}
    log = [F.when(raw["doi"] != now["doi"], F.lit("doi:discarded_placeholder_or_normalized"))]
    for c in ("authors", "journal", "pub_date"):
        blank = is_placeholder(c, raw[c])
        log.append(F.when((raw[c] != "") & blank, F.lit(f"{c}:discarded_placeholder")))
        now[c] = F.when(blank, "").otherwise(raw[c])
    df = df.withColumns({f"__now_{c}": x for c, x in now.items()} | {"__log": F.array(*log), "__url": raw["url"], "__pmid": raw["pmid"], "__best": raw["best_open_access_url"], "__open": F.coalesce(_of(packets, "is_open_access").cast("boolean"), F.lit(False))})
    titles = F.col("__now_title"), have("crossref", "title")
    df = df.withColumn("__score", F.when((F.col("__now_doi") != "") & (titles[0] != "") & (titles[1] != ""), F.round(overlap_ratio(*titles), 4)))
    for r in lattice:
        known = [s for s in r.sources if s in registries]
        if known:
            field, new = F.col(f"__now_{r.field}"), first_nonempty(*[have(s, r.field) for s in known])
            df = df.withColumn("__hit", (new != "") & r.guard(field, new)).withColumn("__new", new)
            df = df.withColumns({"__log": F.array_append("__log", F.when(F.col("__hit"), F.lit(r.log))), f"__now_{r.field}": F.when(F.col("__hit"), F.col("__new")).otherwise(field)})
    none = F.array().cast("array<string>")
    any_open = [F.col(f"__{t}")["is_open_access"] for t in registries]
    return df.select(
        "packet_id", *[F.col(f"__now_{c}").alias(c) for c in FIELDS],
        F.array_distinct(F.array_compact("__log")).alias("repairs"), F.col("__score").alias("doi_title_score"),
        F.when(F.col("__score") < SAME_TITLE, F.array(F.lit("doi_title_mismatch"))).otherwise(none).alias("consistency"),
        F.array_compact(F.array(*[F.when(F.col(f"__{t}").isNotNull(), F.lit(t)) for t in registries])).alias("enrichment_sources"),
        first_nonempty(F.col("__pmid"), *[have(t, "pmid") for t in registries]).alias("pmid"),
        F.coalesce(F.greatest(F.col("__open"), ids.valid_http_url("__url") & F.contains("__url", F.lit(OPEN_HOST)), *[F.coalesce(x, F.lit(False)) for x in any_open]), F.lit(False)).alias("is_open_access"),
        first_nonempty(*[have(t, "best_open_access_url") for t in registries], F.col("__best")).alias("best_open_access_url"),
    )
