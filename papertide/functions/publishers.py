"""Links to a publisher's PDF as links to the article's page: a table of rules by host."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import _URL, host, looks_like_url
from .text import or_empty

#: Of a rule: what in the path it looks for, and what that becomes. TEXT: the text is replaced once; PATTERN: a regular expression; DOI: the pattern shows a path that names a DOI, which makes the link.
TEXT, PATTERN, DOI_PATH = "text", "pattern", "doi path"


class Rule(NamedTuple):
    kind: str
    find: str
    becomes: str
    note: str


#: For parts of the host, the rules in order; the first host that fits decides.
RULES: tuple[tuple[tuple[str, ...], tuple[Rule, ...]], ...] = (
    (("sagepub.com",), (Rule(TEXT, "/doi/pdfdirect/", "/doi/full/", "sage pdfdirect->full"), Rule(TEXT, "/doi/pdf/", "/doi/full/", "sage pdf->full"), Rule(TEXT, "/doi/epdf/", "/doi/full/", "sage epdf->full"))),
    (("wiley.com",), (Rule(TEXT, "/doi/pdfdirect/", "/doi/abs/", "wiley pdfdirect->abs"), Rule(TEXT, "/doi/epdf/", "/doi/abs/", "wiley epdf->abs"), Rule(TEXT, "/doi/pdf/", "/doi/abs/", "wiley pdf->abs"))),
    (("tandfonline.com",), (Rule(TEXT, "/doi/pdf/", "/doi/full/", "tandf pdf->full"), Rule(TEXT, "/doi/epdf/", "/doi/full/", "tandf epdf->full"), Rule(TEXT, "/doi/pdfdirect/", "/doi/full/", "tandf pdfdirect->full"))),
    (("acs.org",), (Rule(TEXT, "/doi/pdf/", "/doi/abs/", "acs pdf->abs"), Rule(TEXT, "/doi/epdf/", "/doi/abs/", "acs epdf->abs"))),
    (("science.org",), (Rule(TEXT, "/doi/pdf/", "/doi/abs/", "science pdf->abs"), Rule(TEXT, "/doi/epdf/", "/doi/abs/", "science epdf->abs"))),
    (("springer.com", "springeropen.com"), (Rule(PATTERN, r"(?i)^.*/content/pdf/(10\..+?)\.pdf$", "/article/$1", "springer content/pdf->article"), Rule(PATTERN, r"(?i)^(.*/article/.*)\.pdf$", "$1", "springer strip .pdf"))),
    (("nature.com",), (Rule(PATTERN, r"(?i)^(.*)\.pdf$", "$1", "nature strip .pdf"),)),
    (("sciencedirect.com",), (Rule(PATTERN, "^(.*)/pdfft$", "$1", "sciencedirect strip /pdfft"), Rule(PATTERN, "^(.*?)/pdfft/.*$", "$1", "sciencedirect strip pdfft segment"))),
    (("oup.com",), (Rule(DOI_PATH, r"(?i)^.*/advance-article-pdf/doi/(10\..*)$", "", "oup advance-article-pdf->doi.org"), Rule(PATTERN, r"(?i)^(.*/article.*)\.pdf$", "$1", "oup strip article .pdf"))),
    (("mdpi.com",), (Rule(PATTERN, "(?i)^(.*)/pdf$", "$1", "mdpi strip /pdf"),)),
    (("frontiersin.org",), (Rule(PATTERN, "(?i)^(.*?)(?:/full)?/*/pdf$", "$1/full", "frontiers /pdf->/full"),)),
    (("cell.com",), (Rule(PATTERN, r"(?i)^.*/heliyon/.*?pdf/(S\d[^/?#]+).*$", "/heliyon/fulltext/$1", "cell heliyon pdf->fulltext"), Rule(PATTERN, r"(?i)^(.*)\.pdf$", "$1", "cell strip .pdf"))),
    (("biomedcentral.com", "bmc.com"), (Rule(PATTERN, r"(?i)^(.*)\.pdf$", "$1", "bmc strip .pdf"),)),
)
GENERIC = Rule(PATTERN, "(?i)^(.*?)/doi/pdfdirect/(.*)$", "$1/doi/abs/$2", "generic doi/pdfdirect->abs")


def _doi_path(path: Column) -> Column:
    """The DOI behind the marker: path parts up to a number or a PDF name."""
    rest = F.filter(F.split(F.regexp_extract(path, r"(?i)/advance-article-pdf/doi/(.*)$", 1), "/"), lambda p: p != "")
    stop = F.filter(F.transform(F.sequence(F.lit(1), F.size(rest)), lambda i: F.when(F.regexp_like(F.element_at(rest, i), F.lit(r"(?i)^\d+$|\.pdf$")), i)), lambda i: i.isNotNull())
    return F.array_join(F.slice(rest, F.lit(1), F.coalesce(F.array_min(stop) - 1, F.size(rest))), "/")


def article_page(url: Column | str) -> Column:
    """Struct of url and note (null if nothing was changed)."""
    x = or_empty(url)
    h, path = host(x, keep_www=True), F.regexp_extract(F.trim(x), _URL, 3)
    base = F.regexp_extract(F.trim(x), "^([^:]+://[^/?#]*)", 1)
    result = lambda u, note: F.struct(u.alias("url"), F.lit(note).alias("note"))

    def apply(rules, fallback: Column) -> Column:
        out = None
        for r in rules:
            if r.kind == TEXT:
                at = F.instr(path, r.find)
                test, to = at > 0, F.concat(base, F.substring(path, F.lit(1), at - 1), F.lit(r.becomes), F.substring(path, at + len(r.find), F.length(path)))
            else:
                test = F.regexp_like(path, F.lit(r.find))
                to = F.concat(F.lit("https://doi.org/"), _doi_path(path)) if r.kind == DOI_PATH else F.concat(base, F.regexp_replace(path, r.find, r.becomes))
            out = F.when(test, result(to, r.note)) if out is None else out.when(test, result(to, r.note))
        return out.otherwise(fallback)

    same = F.struct(x.alias("url"), F.lit(None).cast("string").alias("note"))
    generic = apply((GENERIC,), same)
    out = None
    for hosts, rules in RULES:
        test = F.lit(False)
        for part in hosts:
            test = test | F.contains(h, F.lit(part))
        out = F.when(test, apply(rules, generic)) if out is None else out.when(test, apply(rules, generic))
    return F.when(looks_like_url(x), out.otherwise(generic)).otherwise(same)
