"""Identifiers: urls, DOIs, registry numbers, keys, paths, footnote references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, collapse, key, or_empty, or_null

#: Fixed values.
OPEN_ACCESS = ("frontiersin.org", "mdpi.com", "pmc.ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov")
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
REGISTRY = "pubmed.ncbi.nlm.nih.gov"
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host(url: Column | str, keep_www: bool = False) -> Column:
    """Lower-case host without user and port, and without www. unless kept; empty if there is none."""
    netloc = F.regexp_extract(F.trim(or_empty(url)), _URL, 2)
    out = F.lower(F.regexp_replace(F.regexp_replace(netloc, "^.*@", ""), r":\d*$", ""))
    return out if keep_www else F.regexp_replace(out, r"^www\.", "")


def path(url: Column | str) -> Column:
    return F.regexp_extract(F.trim(or_empty(url)), _URL, 3)


def canonical_url(url: Column | str) -> Column:
    """https, bare host, path without doubled or final slashes and parameters; what is no url, trimmed and in lower case."""
    trimmed = F.trim(or_empty(url))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(path(url), ";[^/]*$", ""), "/{2,}", "/"), "/+$", "")
    return F.when(F.regexp_extract(trimmed, _URL, 2) != "", F.concat(F.lit("https://"), host(url), clean)).otherwise(F.lower(trimmed))


def host_in(url: Column | str, domains: tuple[str, ...] = OPEN_ACCESS) -> Column:
    """Whether the host is one of the domains or below one."""
    h = host(url)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


def host_contains(url: Column | str, source: str) -> Column:
    """Whether the host holds a text; a blank url or text restricts nothing."""
    blank = or_empty(url) == ""
    return F.lit(True) if not source else blank | host(url, keep_www=True).contains(source.lower())


def host_matches(hostname: Column, pattern: str) -> Column:
    """A pattern *.suffix matches the suffix and what is below it, another one itself."""
    hostname = F.lower(hostname)
    if pattern.startswith("*."):
        suffix = pattern[2:].lower()
        return (hostname == suffix) | hostname.endswith("." + suffix)
    return hostname == pattern.lower()


def doi(*xs: Column | str, lower: bool = True) -> Column:
    """The first DOI in the first text that has one, without closing punctuation; else empty."""
    found = [or_null(F.regexp_replace(F.regexp_extract(or_empty(x), DOI, 0), "[).,;]+$", "")) for x in xs]
    out = F.coalesce(*found, F.lit(""))
    return F.lower(out) if lower else out


def pmid(url: Column | str) -> Column:
    """Registry number: 5 to 10 digits at the end of a path on the registry's host."""
    return F.when(host(url, keep_www=True).contains(REGISTRY), F.regexp_extract(path(url), r"/(\d{5,10})/?$", 1)).otherwise("")


def pmid_anywhere(x: Column | str) -> Column:
    return F.regexp_extract(or_empty(x), r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", 1)


def identity_basis(title: Column | str, url: Column | str, doi_: Column | str | None = None, pmid_: Column | str | None = None) -> Column:
    """What a paper is known by: its DOI, else registry number, else canonical url, else title."""
    own_doi = doi(F.coalesce(or_null(doi_), c(url)) if doi_ is not None else url)
    own_pmid = F.trim(F.coalesce(or_null(pmid_), pmid(url)) if pmid_ is not None else pmid(url))
    url_ = canonical_url(url)
    return F.when(own_doi != "", F.concat(F.lit("doi:"), own_doi)).when(own_pmid != "", F.concat(F.lit("pmid:"), own_pmid)).when(url_ != "", F.concat(F.lit("url:"), url_)).otherwise(F.concat(F.lit("title:"), key(or_empty(title))))


def paper_key(*args) -> Column:
    return F.sha2(identity_basis(*args).cast("binary"), 256)


def article_key(alert: Column | str, title: Column | str, url: Column | str) -> Column:
    basis = F.concat_ws("|", collapse(F.lower(or_empty(alert))), key(or_empty(title)), F.lower(F.trim(or_empty(url))))
    return F.sha2(basis.cast("binary"), 256)


def fingerprint(identifier: Column | str) -> Column:
    return F.substring(F.sha2(c(identifier).cast("binary"), 256), 1, 16)


def unwrap_redirect(url: Column | str, host_suffix: str = "scholar.google.com", redirect_path: str = "/scholar_url") -> Column:
    """The target of a redirect link; other urls as they are."""
    target = F.try_url_decode(F.regexp_extract(F.regexp_extract(or_empty(url), _URL, 4), r"(?:^|&)url=([^&]*)", 1))
    is_redirect = host(url, keep_www=True).endswith(host_suffix) & (path(url) == redirect_path)
    return F.when(is_redirect & (F.coalesce(target, F.lit("")) != ""), target).otherwise(or_empty(url))


def looks_like_url(x: Column | str) -> Column:
    return F.regexp_like(or_empty(x), F.lit("(?i)^https?://"))


def looks_like_pdf(x: Column | str) -> Column:
    """A url or path whose path ends in .pdf."""
    return F.regexp_like(or_empty(x), F.lit(r"(?i)^[^?#]*\.pdf(?:[?#].*)?$"))


def valid_http_url(x: Column | str) -> Column:
    return F.regexp_like(F.trim(or_empty(x)), F.lit(r"(?i)^https?://[^/?#\s]+"))


def safe_new_path(x: Column | str, domain: str) -> Column:
    """A relative Markdown path below a domain, with no way out of it."""
    parts = F.split(or_empty(x), "/")
    plain = ~F.exists(parts, lambda p: p.isin("", ".", ".."))
    return (F.size(parts) >= 2) & plain & (F.get(parts, 0) == domain) & or_empty(x).endswith(".md") & ~or_empty(x).contains("\\")


def route_key(stem: Column, path_: Column, taken: Column) -> Column:
    """The stem, or the whole path as a slug if the stem is taken."""
    whole = F.concat_ws("/", F.transform(F.split(F.regexp_replace(path_, r"\.md$", ""), "/"), lambda p: F.regexp_replace(key(p), " +", "-")))
    return F.when(F.array_contains(taken, stem), whole).otherwise(stem)


_REFERENCE = r"\[\^(\d+)\]:\s*(?:\*\*Title:\*\*\s*)?\[([^\]]*)\]\(([^)]+)\)"


def references(markdown: Column | str) -> Column:
    """Footnote definitions with a link, as structs of ref_num, title and url, by number."""
    parts = [F.regexp_extract_all(or_empty(markdown), F.lit(_REFERENCE), F.lit(i)) for i in (1, 2, 3)]
    rows = F.transform(F.sequence(F.lit(1), F.size(parts[0])), lambda i: F.struct(F.element_at(parts[0], i).cast("int").alias("ref_num"), F.trim(F.element_at(parts[1], i)).alias("title"), F.trim(F.element_at(parts[2], i)).alias("url")))
    return F.when(F.size(parts[0]) > 0, F.array_sort(rows, lambda a, b: F.when(a["ref_num"] < b["ref_num"], -1).when(a["ref_num"] > b["ref_num"], 1).otherwise(0)))


def next_reference(markdown: Column | str) -> Column:
    numbers = F.transform(F.regexp_extract_all(or_empty(markdown), F.lit(_REFERENCE), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(numbers), F.lit(0)) + 1


def reference_link(url: Column, text: Column) -> Column:
    """A cited reference's link: its own, else one to the DOI in its text; else empty."""
    found = doi(text, lower=False)
    return F.when(valid_http_url(url), F.trim(url)).when(found != "", F.concat(F.lit("https://doi.org/"), found)).otherwise("")
