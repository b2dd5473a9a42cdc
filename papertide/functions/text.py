"""Text expressions. The normalizers differ on purpose; none stands in for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words after which a full stop doesn't end a sentence.
ABBREVIATIONS = ("vs", "al", "e.g", "i.e", "approx", "ca", "cf", "etc", "Fig")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f) -> Column:
    """f(x) with x computed once for a row, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def or_empty(x: Column | str) -> Column:
    return F.coalesce(c(x), F.lit(""))


def or_null(x: Column | str) -> Column:
    """Blank text, which the data uses as freely as null, as null."""
    return F.nullif(c(x), F.lit(""))


def strip(x: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c(x), r"(?U)^\s+|\s+$", "")


def collapse(x: Column | str) -> Column:
    """Each run of Unicode white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(c(x), r"(?U)\s+", " "))


def collapse_blocks(x: Column | str) -> Column:
    """LF line ends, single spaces and tabs, at most one empty line in a row; none at the ends."""
    x = F.regexp_replace(F.regexp_replace(c(x), "\r\n?", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def key(x: Column | str) -> Column:
    """Lower case, everything but a-z and 0-9 to single spaces; letters with accents turn to spaces."""
    return F.trim(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", " "))


def only_entities(x: Column | str, names: tuple[str, ...]) -> Column:
    """Markup in which these entities, each with its semicolon, stand for characters, and every other & for itself."""
    return F.regexp_replace(c(x), "&(?!(?:" + "|".join(names) + ");)", "&amp;")


def slug(x: Column | str, default: str = "") -> Column:
    out = F.regexp_replace(key(x), " +", "-")
    return F.when(out == "", F.lit(default)).otherwise(out)


def first_nonempty(*xs: Column | str) -> Column:
    return F.coalesce(*[or_null(collapse(x)) for x in xs], F.lit(""))


def first_line(x: Column | str, least: int = 8) -> Column:
    """The first line of at least so many characters, collapsed; else an empty string."""
    lines = F.filter(F.transform(F.split(c(x), "\n"), collapse), lambda s: F.length(s) >= least)
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def is_truncated(x: Column | str) -> Column:
    x = collapse(x)
    return x.endswith("...") | x.endswith("…")


def is_placeholder(name: str, x: Column | str, placeholders: dict[str, tuple[str, ...]]) -> Column:
    return key(collapse(x)).isin(*placeholders.get(name, ())) if placeholders.get(name) else F.lit(False)


def truncate_at_word(x: Column | str, limit: int) -> Column:
    """At most limit characters, cut at the last space inside if there is one, without punctuation at the end."""
    x = collapse(x)
    head = F.substring(x, 1, limit)
    cut = F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(x) <= limit, x).otherwise(F.regexp_replace(cut, r"[\s,;:.\-]+$", ""))


def sentences(x: Column | str) -> Column:
    """Sentences end at . ! or ? before white space and a capital or an opening bracket."""
    return F.split(F.trim(c(x)), r"(?<=[.!?])\s+(?=[A-Z(])")


def plain_sentences(x: Column | str) -> Column:
    """Sentences end at . ! or ? before white space."""
    return F.split(F.trim(c(x)), r"(?<=[.!?])\s+")


def bullet_sentences(x: Column | str) -> Column:
    """sentences(), joined again after an abbreviation; one whole if any would have fewer than four words."""
    ends = F.lit(r"\b(?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.$")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), s)))
        return F.when((F.size(done) > 0) & F.regexp_like(last, ends), joined).otherwise(F.concat(done, F.array(s)))

    parts = F.aggregate(sentences(x), F.array().cast("array<string>"), add)
    short = F.exists(parts, lambda s: F.size(words(key(s))) < 4)
    return F.when((F.size(parts) > 1) & ~short, parts).otherwise(F.array(F.trim(c(x))))


def snippet(x: Column | str, needles: list[str], before: int = 60, after: int = 180) -> Column:
    """The text around the first place of any needle, in lower case; null if there is none."""
    x = collapse(x)
    places = F.filter(F.array(*[F.struct(F.instr(F.lower(x), n).alias("at"), F.lit(i).alias("i"), F.lit(len(n)).alias("n")) for i, n in enumerate(needles)]), lambda p: p["at"] > 0)
    first = F.array_min(places)
    start = F.greatest(F.lit(1), first["at"] - before)
    end = F.least(F.length(x) + 1, first["at"] + first["n"] + after)
    body = F.trim(F.substring(x, start, end - start))
    return F.when(F.size(places) > 0, F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(end <= F.length(x), "...").otherwise("")))


def strip_markup(x: Column | str) -> Column:
    """Tags become spaces; collapsed."""
    return collapse(F.regexp_replace(c(x), "(?s)<[^>]+>", " "))


def strip_comments(x: Column | str) -> Column:
    return F.regexp_replace(c(x), "(?s)<!--.*?-->", "")


def strip_anchors(x: Column | str) -> Column:
    """Links to places in the same document become their text."""
    return F.regexp_replace(c(x), r"\[([^\]]*)\]\(#[^)]*\)", "$1")


def strip_citations(x: Column | str) -> Column:
    """Without [1], [2, 3] and [4-6]; collapsed, no space before punctuation."""
    x = F.regexp_replace(c(x), r"\[\s*\d+(?:\s*[,–-]\s*\d+)*\s*\]", "")
    return F.regexp_replace(collapse(x), r"\s+([,.;:])", "$1")


def phrase_count(text: Column, phrase: Column) -> Column:
    """Times that a phrase stands in a text as whole words; both normalized. Neighbours share no space, so of two in a row one counts."""
    quoted = F.concat(F.lit("(?:^| )"), phrase, F.lit("(?:$| )"))
    return F.when((phrase == "") | (text == ""), F.lit(0)).otherwise(F.regexp_count(text, quoted))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase, or it with its last word in the plural, stands in a text as whole words; both normalized."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    long_y = F.regexp_like(phrase, F.lit("[^ ]{2}y$"))
    plural = F.when(phrase.endswith("s"), phrase).when(long_y, F.concat(F.regexp_replace(phrase, "y$", ""), F.lit("ies"))).otherwise(F.concat(phrase, F.lit("s")))
    return (phrase != "") & (padded.contains(F.concat(F.lit(" "), phrase, F.lit(" "))) | padded.contains(F.concat(F.lit(" "), plural, F.lit(" "))))


def words(x: Column) -> Column:
    """Words of normalized text."""
    return F.filter(F.split(x, " "), lambda w: w != "")


def distinct_nonempty(xs: Column) -> Column:
    """Collapsed values, without empty ones and repeats, in the order of their first place."""
    return F.array_distinct(F.filter(F.transform(xs, collapse), lambda s: s != ""))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common words by the words of the larger set: 1 for equal keys, 0 if either is empty."""
    x, y = F.array_distinct(words(key(a))), F.array_distinct(words(key(b)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(key(a) == key(b), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))
