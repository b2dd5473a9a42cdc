"""Secrets in texts by an inverted index of trigrams. DataFrame operations only.

Each rule is a regular expression, from whose syntax tree a Boolean query of trigrams follows that every match must satisfy, as a disjunction of
conjunctions. The index holds postings of the trigrams that the rules ask for, and of no others: a row for each of them that a text holds, in any case of its letters. A conjunction's
postings are intersected by counting them for each text, before the exchange; texts that satisfy a rule's query are its candidates, and only
they are read again and verified. A rule without mandatory trigrams, as one of digits alone, is run over every text as the postings are made, and
the texts in which it matches are candidates as well.

Spans are the rule's leftmost matches that don't overlap, less those whose group or whole is too short; places are in code points, from
the lengths of what lies between and within matches, summed over a text's matches in order.

Texts are read twice, and those of candidates alone are exchanged, or none where the candidates' keys are few enough to be sent to all tasks. Rows
are known by a digest of id and text. A text's postings are as many as the rules have trigrams at most, a text's matches are one group.

Results for odd rows: a null text is the empty one and has no spans, and the digest of nothing; a very long text is searched whole; rows that are equal in id and text each have all
spans; a null id is an id; no rows give no rows; other columns are left out, whatever their names; letters outside ASCII never stand
for those of a rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Rule:
    """least: of the group's code points; group 0 is the whole match."""

    kind: str
    pattern: str
    group: int
    least: int


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of 24 or more are those of one or more that are so long
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Spans of kinds beyond those: forms that well-known issuers of keys document.
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)

Clause = frozenset[str]
#: A disjunction of conjunctions of trigrams; one that holds an empty conjunction asks for nothing.
Query = frozenset[Clause]
ANY: Query = frozenset([frozenset()])
#: Strings that a part of a pattern may stand for, and conjunctions of a query, above which a part asks for nothing.
STRINGS, CLAUSES = 64, 64


def _least(clauses) -> Query:
    """Without conjunctions that ask for more than another one does."""
    found = set(clauses)
    return frozenset(c for c in found if not any(o < c for o in found))


def _both(a: Query, b: Query) -> Query:
    found = _least(x | y for x, y in product(a, b))
    return found if len(found) <= CLAUSES else min(a, b, key=len)


def _either(queries) -> Query:
    found = _least(c for q in queries for c in q)
    return found if len(found) <= CLAUSES else ANY


def _of_strings(strings: frozenset[str]) -> Query:
    return _either([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _asked(tree) -> tuple[frozenset[str] | None, Query]:
    """What a part of a syntax tree stands for, if that is a few strings in lower case, and else what it asks for."""
    before: frozenset[str] = frozenset([""])
    query, exact = ANY, True
    for op, value in tree:
        strings, asks = _asked_by(op, value)
        if strings is not None and len(before) * len(strings) <= STRINGS:
            before = frozenset(a + b for a, b in product(before, strings))
            continue
        exact = False
        query = _both(query, _of_strings(before))
        before = strings if strings is not None else frozenset([""])
        query = _both(query, asks)
    return (before, _of_strings(before)) if exact else (None, _both(query, _of_strings(before)))


def _asked_by(op, value) -> tuple[frozenset[str] | None, Query]:
    if op is C.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if op is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in value):
        chars = {chr(x).lower() for k, v in value for x in ([v] if k is C.LITERAL else range(v[0], v[1] + 1) if v[1] - v[0] < STRINGS else [])}
        wide = any(k is C.RANGE and v[1] - v[0] >= STRINGS for k, v in value)
        return (frozenset(chars) if not wide and len(chars) <= 8 else None), ANY
    if op is C.SUBPATTERN:
        return _asked(value[-1])
    if op is C.BRANCH:
        parts = [_asked(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and len(union := frozenset().union(*(s for s, _ in parts))) <= STRINGS:
            return union, ANY
        return None, _either([q for _, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, part = value
        strings, asks = _asked(part)
        if strings is not None and most <= 4 and sum(len(strings) ** k for k in range(least, most + 1)) <= STRINGS:
            return frozenset("".join(x) for k in range(least, most + 1) for x in product(strings, repeat=k)), ANY
        return None, (asks if least else ANY)
    if op is C.AT:  # a place, which has no width
        return frozenset([""]), ANY
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """What the lower-case form of a text must hold for a match; ANY if that is nothing. Patterns are in what Python and Java have in common."""
    return _asked(_parser.parse(pattern, re.IGNORECASE if pattern.startswith("(?i)") else 0))[1]


def _row(id_col: str, text_col: str) -> Column:
    named = [F.coalesce(F.concat(F.lit("+"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat(named[0], F.lit("\n"), named[1]).cast("binary")))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, trigrams (places in the sorted list of those asked for), full (kinds of rules without trigrams that match) of each document, written once."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = asked_for(rules)
    text = F.col(f"`{text_col}`")
    named = docs.select(_row(id_col, text_col).alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)])) if wanted else F.array().cast("array<int>")
    whole = [F.when(F.col("text").rlike(r.pattern), F.lit(r.kind)) for r in rules if queries[r.kind] == ANY]
    full = F.array_compact(F.array(*whole)) if whole else F.array().cast("array<string>")
    return cut(named.select("row", "id", held.alias("trigrams"), full.alias("full")))


def asked_for(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})


def candidates(indexed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """row, kinds: the rules whose trigram query a text satisfies, or that match in a scan; texts without any are left out."""
    wanted = {t: i for i, t in enumerate(asked_for(rules))}
    clauses = [(r.kind, n, sorted(wanted[t] for t in clause)) for r in rules if (q := trigram_query(r.pattern)) != ANY for n, clause in enumerate(sorted(map(sorted, q)))]
    of_scan = indexed.select("row", F.explode("full").alias("kind"))
    if clauses:
        # a few rows for each rule, known to the driver: each trigram with the conjunctions that ask for it
        asks = [(t, kind, n, len(ts)) for kind, n, ts in clauses for t in ts]
        table = indexed.sparkSession.createDataFrame(asks, "trigram int, kind string, clause int, size int")
        postings = indexed.select("row", F.explode(F.array_distinct("trigrams")).alias("trigram")).distinct()
        met = postings.join(F.broadcast(table), "trigram").groupBy("row", "kind", "clause").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        of_scan = of_scan.unionAll(met.where("n = size").select("row", "kind"))
    return of_scan.groupBy("row").agg(F.collect_set("kind").alias("kinds"))


#: Candidates whose keys, of 16 bytes each, may be sent to all executors.
FEW = 500_000


def matches(docs: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, kind, start, end of each match in the candidates' texts."""
    found = F.broadcast(found) if found.count() <= FEW else found
    texts = docs.select(_row(id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("text")).join(found, "row")

    def parts(r: Rule) -> Column:
        """What lies before each match, the match and its group; one part more, without a match, at the end."""
        pattern = F.lit(r.pattern)
        zipped = F.arrays_zip(F.split("text", r.pattern, -1).alias("before"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("whole"), F.regexp_extract_all("text", pattern, F.lit(r.group)).alias("held"))
        return F.when(F.array_contains("kinds", r.kind), F.transform(zipped, lambda x: F.struct(F.lit(r.kind).alias("kind"), F.length(x["before"]).alias("before"), F.length(x["whole"]).alias("whole"), (F.length(x["held"]) >= r.least).alias("ok"))))

    # one row for each key, also where rows are equal
    each = texts.select("row", *[parts(r).alias(r.kind) for r in rules]).dropDuplicates(["row"])
    rows = each.select("row", F.posexplode(F.flatten(F.array_compact(F.array(*[r.kind for r in rules])))).alias("n", "x")).select("row", "n", "x.*").where("whole is not null")
    upto = F.sum(F.col("before") + F.col("whole")).over(W.partitionBy("row", "kind").orderBy("n"))
    placed = rows.withColumn("end", upto).where("ok")
    return placed.select("row", "kind", (F.col("end") - F.col("whole")).alias("start"), "end")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, and found: an array of (start, place, kind, end), in order of start, then of the rule, of each document."""
    indexed = index(docs, rules, id_col, text_col)
    place = reduce(lambda rest, x: F.when(F.col("kind") == x[1].kind, x[0]).otherwise(rest), list(enumerate(rules))[::-1], F.lit(len(rules)))
    spans = matches(docs, cut(candidates(indexed, rules)), rules, id_col, text_col)
    of_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "kind", "end"))).alias("found"))
    none = F.array().cast(of_row.schema["found"].dataType)
    return indexed.select("row", "id").join(of_row, "row", "left").select(F.col("id").alias(id_col), F.coalesce("found", none).alias("found"))


def reported(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [r.kind for r in BASE]
    joined = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = F.filter("found", lambda x: x["kind"].isin(*base))
    return scan(docs).select("doc_id", *map(n, base), F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql(kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT n, '{kind}' AS kind, unnest(string_split_regex(text, '{pattern}')) AS before, unnest(regexp_extract_all(text, '{pattern}', 0)) AS whole, unnest(regexp_extract_all(text, '{pattern}', {group})) AS held, unnest(range(len(text) + 1)) AS i, {least} AS least FROM t WHERE regexp_matches(text, '{pattern}')"""


_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: The base rules; the others' forms occur in none of the driver's tables.
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_sql("assign", _ASSIGN, 2, 6)} UNION ALL {_sql("access", "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_sql("hex", "[0-9a-f]{24,}", 0, 24)}),
p AS (SELECT *, sum(length(before) + length(whole)) OVER (PARTITION BY n, kind ORDER BY i) AS stop FROM m WHERE whole IS NOT NULL),
s AS (SELECT n, kind, stop - length(whole) AS start, stop, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS place FROM p WHERE length(held) >= least),
j AS (SELECT n, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) AS spans FROM s GROUP BY n)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN j USING (n)
"""
