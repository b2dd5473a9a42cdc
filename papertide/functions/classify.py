"""Rule tables whose first match decides, and the weights and patterns behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, key, or_empty

#: Publication types that decide before any pattern, in order.
PUBLICATION_TYPES = (("review", "Review"), ("randomized controlled trial", "Human Study: Randomized Controlled Trial"), ("clinical trial", "Human Study: Clinical Trial"), ("case reports", "Case Report"), ("observational study", "Human Study: Observational"))
#: Study types and their patterns, in order.
STUDY_TYPES = (
    ("Systematic Review and Meta-Analysis", r"systematic\s+review.*meta[\-\s]?analysis|meta[\-\s]?analysis.*systematic\s+review"),
    ("Meta-Analysis", r"\bmeta[\-\s]?analysis\b"),
    ("Systematic Review", r"\bsystematic\s+review\b"),
    ("Human Study: Randomized Controlled Trial", r"\brandomi[sz]ed\s+controlled\s+trial\b|\brct\b"),
    ("Human Study: Clinical Trial", r"\bclinical\s+trial\b|\bcontrolled\s+trial\b"),
    ("Human Study: Cohort Study", r"\bcohort\s+study\b|\bprospective\s+study\b|\bretrospective\s+study\b"),
    ("Human Study: Cross-Sectional", r"\bcross[\-\s]?sectional\b"),
    ("Human Study: Case-Control", r"\bcase[\-\s]?control\b"),
    ("Human Study: Observational", r"\bobservational\s+study\b"),
    ("Animal Study: In Vivo", r"\bin\s+vivo\b|\banimal\s+study\b|\banimal\s+model\b|\bmouse\s+model\b|\brat\s+model\b|\bmice\b.*\bstudy\b|\brats\b.*\bstudy\b"),
    ("Cell Study: In Vitro", r"\bin\s+vitro\b|\bcell\s+line\b|\bcell\s+culture\b|\bcultured\s+cells\b"),
    ("Narrative Review", r"\bnarrative\s+review\b"),
    ("Review", r"\breview\b|\boverview\b"),
    ("Computational Study", r"\bcomputational\b|\bin\s+silico\b|\bmolecular\s+docking\b|\bnetwork\s+pharmacology\b"),
    ("Case Report", r"\bcase\s+report\b|\bcase\s+series\b"),
)
DEFAULT_STUDY_TYPE = "Research Article"
#: Signs of a page that isn't the article, weak and fatal ones, and fatal titles.
WEAK = {"javascript_required": r"enable\s+javascript|javascript\s+(is\s+)?required", "bot_challenge": r"verify\s+you\s+are\s+human|checking\s+your\s+browser|cloudflare", "cookie_wall": r"accept\s+(all\s+)?cookies|cookie\s+preferences", "access_denied": r"access\s+denied|request\s+blocked|forbidden"}
FATAL = {"captcha_page": r"captcha\s+challenge|please\s+confirm\s+you\s+are\s+a\s+human", "robot_page": r"(?:^|\n)\s*(?:are\s+you\s+a\s+robot\??|verify\s+you\s+are\s+human)\s*(?:$|\n)", "challenge_page": r"checking\s+your\s+browser|enable\s+javascript\s+and\s+cookies\s+to\s+continue", "publisher_error_page": r"there\s+was\s+a\s+problem\s+providing\s+the\s+content\s+you\s+requested"}
FATAL_TITLE = r"^(?:are\s+you\s+a\s+robot\??|access\s+denied|just\s+a\s+moment\.?|new\s+tab|there\s+was\s+a\s+problem\s+providing\s+the\s+content\s+you\s+requested)$"
FATAL_ISSUES = ("invalid_title", "doi_title_mismatch", *FATAL)
#: Groups of sections by their heading, in order, with the pattern of each.
SECTION_GROUPS = (("abstract", r"\babstract\b"), ("results", r"\b(?:results?|outcomes?|findings?)\b"), ("conclusion", r"\bconclusions?\b"), ("introduction", r"\b(?:introduction|background)\b"), ("discussion", r"\bdiscussion\b"), ("traditional", r"\b(?:traditional|ethnobotan\w*|ethnomedic\w*|folk use|historical use)\b"))
SKIPPED_SECTION = r"(?:^|\s)(?:figures?|tables?|extras?|graphical abstract|western blot|extraction of|hplc analysis|gene expression|statistical analysis|credit authorship|authorship contribution|ethical statements?|uncited references?|declaration of competing|supplementary data|data availability|acknowledg|funding)(?:\s|$)"
#: Signs of species, methods, quantities and animal work.
SPECIES = r"(?i)\b(?:rats?|mice|mouse|murine|rodents?|rabbits?|piglets?|zebrafish|in vivo|animals?)\b"
METHODS = r"\b(?:approach|method|methods|process|processing|procedure|protocol|technique)\b[\w\s]{0,80}?\b(?:was|were)\b\s+(?:used|applied|employed|developed|performed)"
QUANTITY = r"\d[\d.,]*\s*(?:%|mg|µg|μg|g|kg|ml|mmhg|mmol|µmol|μmol|iu|kcal|fold)\b|\d[\d.]*\s*±\s*\d|\bp\s*<\s*0\.\d|\d[\d.]*\s*(?:vs|versus)\s*[\d.]"
PRECLINICAL = r"\b(?:animal|animals|preclinical|in vivo|rat|rats|mouse|mice)\b"
PRECLINICAL_PLAN = r"\b(?:animal|preclinical|in vivo|rat|rats|mouse|mice)\b"
CITATION = r"\[(?:\d+(?:\s*[-,]\s*\d+)*)\]|\((?:[A-Z][A-Za-z'’-]+(?:\s+et\s+al\.)?\s*,?\s*)?(?:19|20)\d{2}[a-z]?\)"
LINKED_CITATION = r"\[[^\]\n]*(?:19|20)\d{2}[a-z]?\]\(#[^)]+\)"


#: Words that claim a benefit, and a quantity of a constituent.
HEALTH_CLAIM = r"\b(?:treats?|treatment|cures?|prevents?|prevention|improves?|effective|efficacy|therapeutic|heals?|reduces? the risk)\b"
CONSTITUENT = r"\d[\d.,]*\s*(?:mg|µg|μg|g)\b"
#: Fixed value: what stands between an entity and its definition.
_DEFINES = r"(?:es|s)?(?: fruits?| plants?| trees?| species| genus)?\s+(?:is|are|include|includes|comprise|comprises|refers to|denotes)\b"


def like(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(pattern))


def claims_benefit(x: Column) -> Column:
    return like(key(x), HEALTH_CLAIM)


def has_composition(body: Column) -> Column:
    """Whether a sentence gives the quantities of three constituents or more."""
    sentences = F.split(F.translate(or_empty(body), "\u202f", " "), r"(?<=[.!?])\s+")
    return F.exists(sentences, lambda s: F.regexp_count(s, F.lit(CONSTITUENT)) >= 3)


def defines(entity: Column, lead: Column) -> Column:
    """Whether a lead says what an entity is, and not why it matters."""
    return (key(entity) != "") & F.regexp_like(key(lead), F.concat(F.lit("^(?:the )?"), key(entity), F.lit(_DEFINES)))


def bullet_text(quote: Column) -> Column:
    """A passage as text of its own: without its citations, links to places and empty brackets."""
    bare = F.aggregate(citation_markers(quote), F.trim(quote), lambda text, m: F.replace(text, m, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(bare, r"\[([^\]\n]+)\]\(#[^)]+\)", "$1"), r"\[\^\d+\]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\(\s*(?:[;,]\s*)*\)", ""), r"\s+([,.;:!?])", "$1")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), "^[- ]+", "")


def thesis_text(quote: Column) -> Column:
    """A sentence on a study's aim as the thesis that it looks into."""
    text = F.regexp_replace(bullet_text(quote), r"(?i)^(?:The\s+)?(?:objective|aim)\s+(?:of\s+(?:this|the)\s+study\s+)?was\s+to\s+(?:investigate|evaluate|assess|determine)\s+whether\s+", "")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def first_of(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    out = None
    for test, value in rules:
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def names_where(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])) if tests else F.array().cast("array<string>")


def study_type(title: Column, abstract: Column, publication_types: Column, mesh: Column, body: Column) -> Column:
    kinds = F.transform(F.coalesce(publication_types, F.array().cast("array<string>")), F.lower)
    combined = F.lower(F.concat_ws(" ", or_empty(title), or_empty(abstract), F.array_join(kinds, " "), F.array_join(F.coalesce(mesh, F.array().cast("array<string>")), " "), or_empty(body)))
    has = lambda x: F.array_contains(kinds, x)
    rules = [(has("meta-analysis") & has("systematic review"), "Systematic Review and Meta-Analysis"), (has("meta-analysis"), "Meta-Analysis"), (has("systematic review"), "Systematic Review")]
    rules += [(has(x), value) for x, value in PUBLICATION_TYPES]
    rules += [(like(combined, pattern), value) for value, pattern in STUDY_TYPES]
    return first_of(rules, DEFAULT_STUDY_TYPE)


def is_preclinical(*fields: Column) -> Column:
    return like(key(F.concat_ws(" ", *[or_empty(x) for x in fields])), PRECLINICAL)


def is_methods_statement(x: Column) -> Column:
    return like(key(x), METHODS)


def has_quantity(x: Column) -> Column:
    """Over normalized text, as the rule says; so % and the decimal point never count."""
    return like(key(x), QUANTITY)


def has_species(x: Column) -> Column:
    return like(x, SPECIES)


def animal_model(*fields: Column) -> Column:
    """The animal model named in the fields, with what was done to it if said; else empty."""
    text = F.concat_ws(" ", *[or_empty(x) for x in fields])
    qualified = F.lower(F.regexp_extract(text, r"(?i)\b([a-z][a-z-]*(?:-fed|-induced|-treated|-deficient)\s+(?:rats|mice))\b", 1))
    return F.when(qualified != "", qualified).otherwise(F.lower(F.regexp_extract(text, r"(?i)\b(rats|mice|rabbits|piglets|zebrafish)\b", 1)))


def with_scope(sentence: Column, model: Column) -> Column:
    """A sentence on animal work, led by its model unless it names a species."""
    prefix = F.concat(F.lit("In "), model, F.lit(", "))
    body = F.when(F.startswith(F.lower(sentence), F.lower(prefix)), F.substring(sentence, F.length(prefix) + 1, F.length(sentence))).otherwise(sentence)
    second = F.substring(body, 2, 1)
    lowered = F.when((second != F.upper(second)), F.concat(F.lower(F.substring(body, 1, 1)), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    return F.when(has_species(sentence) | (model == ""), sentence).otherwise(F.concat(prefix, lowered))


def section_group(heading: Column) -> Column:
    """The group that a heading names itself; null if none."""
    return first_of([(like(key(heading), pattern), name) for name, pattern in SECTION_GROUPS])


def is_relevant_section(heading: Column) -> Column:
    return ~key(heading).isin("document metadata", "outline", "published by") & ~like(key(heading), SKIPPED_SECTION)


def citation_markers(x: Column) -> Column:
    """Citations in a text: links to references first, then numbers and years in brackets; each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(x, F.lit(LINKED_CITATION), F.lit(0)), F.regexp_extract_all(x, F.lit(CITATION), F.lit(0))))


def canonical_marker(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"\]\(#[^)]+\)", "]")


def marker_matches(marker: Column, reference: Column) -> Column:
    """Whether a citation means a reference: by its number, else by year and surname."""
    seen = canonical_marker(marker)
    number = F.regexp_extract(seen, r"^\[(\d+)\]$", 1)
    by_number = F.regexp_extract(reference, r"^\s*(?:(\d+)\.|\[(\d+)\])", 1)
    by_bracket = F.regexp_extract(reference, r"^\s*(?:(\d+)\.|\[(\d+)\])", 2)
    year, surname = F.regexp_extract(seen, r"(?i)\b(?:19|20)\d{2}[a-z]?\b", 0), F.regexp_extract(seen, r"[A-Za-z'’-]{3,}", 0)
    text = key(F.substring(reference, 1, 1000))
    return F.when(number != "", (by_number == number) | (by_bracket == number)).otherwise((year != "") & (surname != "") & text.contains(key(year)) & text.contains(key(surname)))


def fatal_issues(title: Column, abstract: Column, body: Column, consistency: Column | None = None) -> Column:
    t, a, b = (collapse(or_empty(x)) for x in (title, abstract, body))
    combined = F.concat_ws("\n", t, a, b)
    found = names_where({"invalid_title": like(t, "(?i)" + FATAL_TITLE)} | {n: like(combined, "(?i)" + p) for n, p in FATAL.items()})
    if consistency is not None:
        found = F.concat(F.array_intersect(F.coalesce(consistency, F.array().cast("array<string>")), F.array(*map(F.lit, FATAL_ISSUES))), found)
    return F.array_distinct(found)


def extraction_issues(title: Column, abstract: Column, body: Column, consistency: Column | None = None, least_body: int = 800, least_abstract: int = 120) -> Column:
    t, a, b = (collapse(or_empty(x)) for x in (title, abstract, body))
    useful_body, useful_abstract = F.length(b) >= least_body, F.length(a) >= least_abstract
    combined = F.lower(F.concat_ws(" ", t, a, b))
    tests = {"title_missing": t == "Unknown Title", "body_missing": b == "", "content_too_short": ~useful_body & ~useful_abstract}
    tests |= {n: ~useful_body & like(combined, p) for n, p in WEAK.items()}
    return F.array_distinct(F.concat(fatal_issues(title, abstract, body, consistency), names_where(tests)))


def extraction_score(title: Column, abstract: Column, body: Column, others: list[Column], consistency: Column | None = None) -> Column:
    t, a, b = (collapse(or_empty(x)) for x in (title, abstract, body))
    issues = extraction_issues(title, abstract, body, consistency)
    out = F.when((t != "") & (t != "Unknown Title"), 200).otherwise(0) + F.least(F.length(a), F.lit(1500)) + F.least(F.length(b), F.lit(5000))
    for x in others:
        out = out + F.when(collapse(or_empty(x)) != "", 50).otherwise(0)
    return out - F.size(issues) * 250 - F.when(F.arrays_overlap(issues, F.array(*map(F.lit, FATAL_ISSUES))), 10_000).otherwise(0)


def content_score(body: Column) -> Column:
    b = collapse(or_empty(body))
    out = F.length(b)
    for pattern in WEAK.values():
        out = out - F.when(like(F.lower(b), pattern), 1000).otherwise(0)
    return F.when(b == "", 0).otherwise(out)
