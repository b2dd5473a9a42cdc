"""The page catalog: search, phrase retrieval, tags, references, containment of passages, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, udfs
from ..functions.text import has_phrase, key, let, or_empty, phrase_count, snippet, strip, words
from .intake import STARTED

#: Weights of fields in search, and in retrieval.
SEARCH = {"title": 30.0, "tags": 20.0, "permalink": 20.0, "path": 15.0, "body": 15.0}
RETRIEVAL = {"title": 240.0, "keywords": 180.0, "abstract": 120.0, "full_text": 25.0, "alert": 220.0}
#: Names too general to mean a page, and words too general to be shared evidence.
GENERIC = ("activity", "analysis", "article", "benefit", "benefits", "biology", "care", "chemical", "chemicals", "compound", "compounds", "content", "current events", "development", "disease", "diseases", "evidence", "food", "foods", "health", "healing", "medicine", "ministry", "model", "models", "natural healing", "prevention", "product", "products", "research", "study", "studies", "therapy", "treatment", "vitamin")
STOPWORDS = ("about", "after", "among", "analysis", "article", "based", "benefit", "benefits", "clinical", "disease", "effect", "effects", "evidence", "expanding", "findings", "health", "human", "mechanism", "mechanisms", "meta", "model", "models", "potential", "research", "review", "role", "signal", "study", "studies", "systematic", "therapy", "treatment", "using", "with", "without", "from", "into", "this", "that", "their", "these", "those", "were", "been", "have", "has", "and", "the", "for", "activity", "administration", "associated", "blend", "citrus", "dose", "induced", "metabolic", "metabolism", "mouse", "mice", "rat", "rats", "pink", "preclinical", "supplement", "supplementation", "versus")
#: A passage of so many words or more is looked up by one of them.
LEAST = 4
#: Characters of the runs by which an identifier is looked up in urls.
GRAM = 5


def search(pages: DataFrame, query: str, mode: str = "all", fields: list[str] | None = None, limit: int = 20, normalize=key) -> DataFrame:
    """pages(path, title, stem, tags, permalink, body) by weighted coverage of the query's words, with a bonus for an exact name.

    any: a word is enough. all: each word is in some field. phrase: the whole query is in a field.
    """
    if mode not in ("any", "all", "phrase"):
        raise ValueError(f"unknown mode {mode}")
    terms = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in query.lower()).split()
    if not terms:
        raise ValueError("query must contain at least one letter or number")
    q = " ".join(terms)
    units = [q] if mode == "phrase" else terms
    chosen = fields or list(SEARCH)
    raw = {"title": or_empty("title"), "tags": F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), "permalink": or_empty("permalink"), "path": or_empty("path"), "body": or_empty("body")}
    df = pages.withColumns({f"__{n}": normalize(x) for n, x in raw.items() if n != "body"} | {"__stem": normalize(or_empty("stem"))})
    wanted = F.array(*[F.lit(u) for u in units])
    hits = lambda n: let(normalize(raw[n]), lambda t: F.filter(wanted, lambda u: F.contains(t, u)))
    df = df.withColumns({f"__hits_{n}": hits(n) for n in chosen})
    matched = F.array_sort(F.array_distinct(F.concat(*[F.col(f"__hits_{n}") for n in chosen])))
    df = df.withColumn("matched_terms", matched)
    df = df.where(F.size("matched_terms") >= (len(set(terms)) if mode == "all" else 1))
    score = sum((F.lit(SEARCH[n]) * F.size(F.array_distinct(f"__hits_{n}")) / len(units) for n in chosen), F.lit(0.0))
    bonus = F.when(F.col("__title") == q, 30).when(F.col("__permalink") == q, 25).when(F.col("__path") == q, 20).when(F.col("__stem") == q, 15)
    bonus = (bonus.when(F.contains("__title", F.lit(q)), 10) if mode == "phrase" else bonus).otherwise(0)
    found = F.array_compact(F.array(*[F.when(F.size(f"__hits_{n}") > 0, F.lit(n)) for n in chosen]))
    out = df.select("path", "title", F.round(F.least(score + bonus, F.lit(100.0)), 2).alias("score"), found.alias("matched_fields"), "matched_terms", snippet(or_empty("body"), units).alias("snippet"))
    return out.orderBy(F.desc("score"), F.lower("path"), "path").limit(limit)


def aliases(title: Column, stem: Column, normalize=key) -> Column:
    """The names that a page goes by: title and stem without opening words, unless general or short."""
    bare = lambda x: F.regexp_replace(normalize(or_empty(x)), r"^(?:the|what is|what are|an introduction to)\s+", "")
    return F.filter(F.array_distinct(F.array(bare(title), bare(stem))), lambda a: (F.length(a) >= 4) & ~a.isin(*GENERIC))


def ngrams(xs: Column, n: int) -> Column:
    """Distinct runs of n words."""
    return F.when(F.size(xs) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(xs) - n + 1), lambda i: F.array_join(F.slice(xs, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def eligible(pages: DataFrame, packets: DataFrame, most_words: int = 6, normalize=key) -> DataFrame:
    """Pairs of packet_id and path whose alias is a phrase of a packet field: joined by word n-grams, not page by page.

    pages(path, title, stem), packets(packet_id and the fields of RETRIEVAL). An alias of more words is looked up by its first most_words.
    """
    names = pages.select("path", F.explode(aliases(F.col("title"), F.col("stem"), normalize)).alias("alias"))
    names = names.withColumn("gram", F.array_join(F.slice(words(F.col("alias")), 1, most_words), " "))
    texts = packets.select("packet_id", F.explode(F.array(*[normalize(or_empty(f)) for f in RETRIEVAL])).alias("text")).where("text <> ''").withColumn("w", words(F.col("text")))
    grams = texts.select("packet_id", "text", F.explode(F.array_distinct(F.flatten(F.array(*[ngrams(F.col("w"), n) for n in range(1, most_words + 1)])))).alias("gram"))
    hit = grams.join(names, "gram").where(phrase_count(F.col("text"), F.col("alias")) > 0)
    return hit.groupBy("packet_id", "path").agg(F.array_sort(F.collect_set("alias")).alias("entity_matches"))


def retrieve(pages: DataFrame, packets: DataFrame, domain: str, include_background: bool = True, limit: int = 10, normalize=key) -> DataFrame:
    """The pages of a domain that a packet is about, by its fields' mentions of them, tags, folders and shared words."""
    inside = pages.where(F.get(F.split("path", "/"), 0) == domain)
    full = F.split(or_empty("full_text"), r"(?im)^#{1,6}\s+(?:references|bibliography|works cited)\s*$", 2)[0]
    packets = packets.withColumn("full_text", full if include_background else F.lit(""))
    pairs = eligible(inside, packets, normalize=normalize)
    texts = packets.select("packet_id", *[normalize(or_empty(f)).alias(f"__{f}") for f in RETRIEVAL])
    df = pairs.join(inside.select("path", "title", "tags", "body"), "path").join(texts, "packet_id")
    all_ = F.trim(F.regexp_replace(F.concat_ws(" ", *[F.col(f"__{f}") for f in RETRIEVAL]), " +", " "))

    def mentions(f: str) -> Column:
        return F.aggregate("entity_matches", F.lit(0), lambda a, x: a + F.least(phrase_count(F.col(f"__{f}"), x), F.lit(3)))

    parts = {f: mentions(f) * w for f, w in RETRIEVAL.items()}
    phrases = lambda xs: F.filter(F.transform(xs, normalize), lambda p: (p != "") & ~p.isin(*GENERIC) & (phrase_count(all_, p) > 0))
    folders = F.split("path", "/")
    parts["tags"] = F.least(F.size(phrases(F.coalesce("tags", F.array().cast("array<string>")))), F.lit(8)) * 18.0
    parts["category"] = F.size(F.array_distinct(phrases(F.slice(folders, F.lit(2), F.greatest(F.size(folders) - 2, F.lit(0)))))) * 30.0
    shared = F.filter(F.array_intersect(words(all_), words(normalize(or_empty("body")))), lambda t: (F.length(t) >= 5) & ~t.isin(*STOPWORDS))
    parts["body"] = F.least(F.size(shared), F.lit(20)) * 1.5
    components = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*[x.cast("double") for x in parts.values()])), lambda k, v: v > 0)
    df = df.select("packet_id", "path", "title", "entity_matches", F.slice(F.array_sort(shared), 1, 30).alias("matched_terms"), components.alias("score_components"))
    df = df.withColumn("score", F.round(F.aggregate(F.map_values("score_components"), F.lit(0.0), lambda a, x: a + x), 2))
    at = F.row_number().over(W.partitionBy("packet_id").orderBy(F.desc("score"), F.lower("path"), "path"))
    return df.withColumn("rank", at).where(F.col("rank") <= limit)


def tag_counts(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def audit_tags(pages: DataFrame, include_all: bool = False, normalize=key) -> DataFrame:
    """Tags that differ only in spelling: their variants, the most frequent one and pages that have them."""
    used = pages.select("path", F.explode("tags").alias("tag")).withColumn("normalized", normalize(F.col("tag")))
    per_tag = used.groupBy("normalized", "tag").agg(F.count("*").alias("n"))
    # the least five paths of a tag, also before the exchange, however many pages have it
    place = F.dense_rank().over(W.partitionBy("normalized").orderBy("path"))
    paths = used.withColumn("place", place).where("place <= 5").groupBy("normalized").agg(F.array_sort(F.collect_set("path")).alias("example_paths"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.lower("tag").alias("l"), "tag", F.col("n").alias("count"))))
    groups = per_tag.groupBy("normalized").agg(F.sum("n").alias("total"), ranked.alias("v"))
    out = groups.join(paths, "normalized").select("normalized", "total", F.get("v", F.lit(0))["tag"].alias("suggested_canonical"), F.transform("v", lambda x: F.struct(x["tag"].alias("tag"), x["count"].alias("count"))).alias("variants"), "example_paths")
    return out if include_all else out.where(F.size("variants") >= 2)


def suggest_tags(counts: DataFrame, query: str, limit: int = 20, normalize=key) -> DataFrame:
    q = F.lit(" ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in query.lower()).split()))
    t = normalize(F.col("tag"))
    own, other = words(q), F.array_distinct(words(t))
    forward, back = F.size(F.filter(own, lambda w: F.contains(t, w))), F.size(F.filter(other, lambda w: F.contains(q, w)))
    score = F.when(q == t, 100.0).when(F.contains(t, q), 80.0).when(F.contains(q, t), 70.0).when(forward > 0, 50.0 * forward / F.size(own)).when(back > 0, 40.0 * back / F.size(other)).otherwise(0.0)
    return counts.select("tag", F.col("n").alias("count"), F.round(score, 2).alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("count"), F.lower("tag"), "tag").limit(limit)


def tags_in(content: DataFrame, counts: DataFrame, limit: int = 10) -> DataFrame:
    """For each row of content(id, text, tags) the known tags that its text names and it has not, most frequent first."""
    known = counts.select("tag", "n", F.regexp_replace(F.lower("tag"), r"\s+", " ").alias("lower_tag"))
    first = lambda x: F.regexp_extract(x, "[a-z0-9]+", 0)
    text = F.lower(F.regexp_replace(or_empty("text"), r"\s+", " "))
    rows = content.select("id", text.alias("text"), F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower).alias("have"))
    tokens = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    pairs = tokens.join(known.withColumn("token", first(F.col("lower_tag"))), "token").select("id", "tag", "n", "lower_tag")
    hit = pairs.join(rows, "id").where(F.contains("text", F.col("lower_tag")) & ~F.array_contains("have", F.col("lower_tag")))
    at = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "tag"))
    return hit.select("id", "tag", "n").withColumn("rank", at).where(F.col("rank") <= limit)


def reference_rows(pages: DataFrame) -> DataFrame:
    return pages.select("path", F.explode(ids.references("body")).alias("r")).select("path", "r.*")


def cited_in(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """The first page, by path and number, that cites each url: equal, equal without protocol, or of one canonical form."""
    clean = lambda x: F.regexp_replace(F.lower(F.trim(x)), "/+$", "")
    forms = lambda x: F.array_distinct(F.array(F.concat(F.lit("u:"), F.regexp_replace(clean(x), "^https?://", "")), F.concat(F.lit("c:"), ids.canonical_url(clean(x)))))
    have = reference_rows(pages).select("path", "ref_num", F.explode(forms(F.col("url"))).alias("form"))
    want = urls.select("url", F.explode(forms(F.col("url"))).alias("form"))
    return want.join(have, "form").groupBy("url").agg(F.min(F.struct("path", "ref_num")).alias("x")).select("url", "x.*")


#: Passages without a word inside that are compared with every text in one expression at most; more are looked up by characters.
FEW = 1000
#: Words of a passage of which the rarest is looked for.
LONGEST = 3


def containing(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Pairs of documents(id, text) and passages(item_id, passage) where the text holds the passage as it is.

    A passage is looked up by the rarest of its LONGEST longest words but the first and last, which in a text may be parts of longer ones, and then compared
    in full. One without such a word is looked up by its rarest run of three characters or fewer; if there are no more than FEW, they are compared with
    every text in one expression instead.
    """
    p = passages.where("passage <> ''").withColumn("w", F.split(strip(F.col("passage")), r"(?U)\s+"))
    docs = documents.where(F.col("text").isNotNull())
    words_ = lambda x: F.array_distinct(F.split(x, r"(?U)\s+"))
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    # any of them leads to the passage; long words are rare ones mostly, and only theirs are counted
    longest = F.slice(F.sort_array(F.transform(F.array_distinct(inner), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), 1, LONGEST)
    found = _found_by(docs, p.where(F.size("w") >= LEAST), words_(F.col("text")), F.transform(longest, lambda x: x["w"]))
    short = p.where(F.size("w") < LEAST).select("item_id", "passage")
    if short.limit(FEW + 1).count() > FEW:
        runs = lambda x, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))
        own = F.array_distinct(F.when(F.length("passage") >= 3, runs(F.col("passage"), 3)).otherwise(F.array(F.col("passage"))))
        all_ = F.array_distinct(F.flatten(F.array(*[runs(F.col("text"), n) for n in (1, 2, 3)])))
        return found.unionAll(_found_by(docs, short, all_, own))
    few = F.broadcast(short.agg(F.collect_list(F.struct("item_id", "passage")).alias("short")))
    hits = docs.join(few).select("id", F.explode(F.filter("short", lambda s: F.contains(F.col("text"), s["passage"]))).alias("s")).select("id", "s.item_id")
    return found.unionAll(hits.distinct())


def _found_by(docs: DataFrame, passages: DataFrame, of_text: Column, of_passage: Column) -> DataFrame:
    """Pairs by the part of each passage that fewest texts hold; a passage with a part that no text holds is in none."""
    parts = passages.select("item_id", F.explode(of_passage).alias("part"))
    met = docs.select("id", F.explode(of_text).alias("part")).join(parts.select("part").distinct(), "part", "left_semi")
    often = met.groupBy("part").agg(F.count("*").alias("often"))
    rarest = parts.join(often, "part", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "part")).alias("x")).where("x.often > 0").select("item_id", "x.part")
    pairs = met.join(rarest, "part").select("id", "item_id")
    both = pairs.join(docs.select("id", "text"), "id").join(passages.select("item_id", "passage"), "item_id")
    return both.where(F.contains("text", F.col("passage"))).select("id", "item_id").distinct()


def duplicate_papers(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(identifier) against references: part of the url, the same canonical url, or the same title."""
    refs = reference_rows(pages).select("path", "ref_num", F.col("url").alias("ref_url"), F.col("title").alias("ref_title"))
    want = probes.select("identifier", F.lower(F.trim("identifier")).alias("low"), ids.canonical_url("identifier").alias("canonical"), key(F.col("identifier")).alias("title"))
    by_url = want.where("canonical <> ''").join(refs.withColumn("canonical", ids.canonical_url("ref_url")), "canonical")
    by_title = want.where("title <> ''").join(refs.withColumn("title", key(F.col("ref_title"))), "title")
    # an identifier inside a url shares the url's runs of GRAM characters: the rarest of its own leads to it
    grams = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - GRAM + 1), lambda i: F.substring(x, i, F.lit(GRAM))))
    urls = refs.select(F.lower("ref_url").alias("url")).distinct()
    held = urls.where(F.length("url") >= GRAM).select("url", F.explode(grams(F.col("url"))).alias("gram"))
    parts = want.where(F.length("low") >= GRAM).select("low", F.explode(grams(F.col("low"))).alias("gram")).distinct()
    often = held.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often"))
    rarest = parts.join(often, "gram", "left").groupBy("low").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("x")).where("x.often > 0").select("low", "x.gram")
    near = rarest.join(held, "gram").where(F.contains("url", F.col("low"))).select("low", "url")
    short = want.where((F.col("low") != "") & (F.length("low") < GRAM)).select("low").distinct()
    every = urls.select("url", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("url") - n + 1, F.lit(1))), lambda i: F.substring(F.col("url"), i, n)))))).alias("low"))
    near = near.unionAll(every.join(short, "low").select("low", "url")).distinct()
    inside = want.join(near, "low").join(refs.withColumn("url", F.lower("ref_url")), "url")
    columns = ["identifier", "path", "ref_num", "ref_url"]
    return by_url.select(columns).unionAll(by_title.select(columns)).unionAll(inside.select(columns)).distinct()


def merge_duplicate_checks(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """hits(check_id, n, path, ref_num, ref_url), papers(check_id, n, paper_key, workflow_state): of all checks of one subject the distinct hits, and the first paper under way, else the first."""
    content = hits.groupBy("check_id").agg(F.array_sort(F.collect_set(F.struct(or_empty("path").alias("path"), F.coalesce(F.col("ref_num").cast("string"), F.lit("")).alias("ref_num"), or_empty("ref_url").alias("ref_url")))).alias("content_hits"))
    started = F.coalesce("workflow_state", F.lit("")).isin(*STARTED)
    best = papers.groupBy("check_id").agg(F.min_by(F.struct("paper_key", "workflow_state"), F.struct(~started, "n")).alias("paper"))
    out = content.join(best, "check_id", "full")
    found = F.coalesce("content_hits", F.array().cast("array<struct<path:string,ref_num:string,ref_url:string>>"))
    return out.select("check_id", F.size(found).alias("content_hit_count"), found.alias("content_hits"), "paper.paper_key", "paper.workflow_state")


def lint(pages: DataFrame) -> DataFrame:
    """pages(path, error, title, tags, tags_is_list, body): codes of what is wrong with each; only pages with any."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    repeated = F.array_distinct(F.filter(tags, lambda t: F.size(F.filter(tags, lambda u: F.lower(u) == F.lower(t))) > 1))
    bad = F.col("error").isNotNull()
    codes = F.array_compact(
        F.array(
            F.when(bad, "invalid_frontmatter"),
            F.when(~bad & (strip(or_empty("title")) == ""), "missing_title"),
            F.when(~bad & F.col("tags_is_list").isNull(), "missing_tags"),
            F.when(~bad & ~F.col("tags_is_list"), "tags_not_list"),
            F.when(~bad & F.col("tags_is_list") & (F.size(repeated) > 0), "duplicate_tags"),
            F.when(strip(or_empty("body")) == "", "empty_body"),
        )
    )
    return pages.select("path", codes.alias("issues")).where(F.size("issues") > 0)


def lint_summary(pages: DataFrame, limit: int = 50) -> DataFrame:
    """One row: how many pages were read, how many have something wrong, and the first of those by path."""
    bad = lint(pages)
    first = bad.orderBy("path").limit(limit).agg(F.array_sort(F.collect_list(F.struct("path", "issues"))).alias("pages"))
    return first.select(pages.agg(F.count("*")).scalar().alias("scanned"), bad.agg(F.count("*")).scalar().alias("with_issues"), "pages")


def title_matches(pages: DataFrame, titles: DataFrame, limit: int = 5, min_score: float = 30.0) -> DataFrame:
    """titles(title_id, wanted): the pages whose title, stem or path is most like each.

    A pair without a common word has no score, so pairs are joined by words.
    """
    w = titles.select("title_id", key(or_empty("wanted")).alias("wanted"))
    p = pages.select("path", "title", key(or_empty("title")).alias("t"), key(or_empty("stem")).alias("s"), key(F.col("path")).alias("pt"))
    all_words = lambda *xs: F.array_distinct(F.concat(*[words(F.col(x)) for x in xs]))
    held = p.select("path", F.explode(all_words("t", "s", "pt")).alias("word"))
    asked = w.select("title_id", F.explode(all_words("wanted")).alias("word"))
    pairs = asked.join(held, "word").select("title_id", "path").distinct()
    both = pairs.join(w, "title_id").join(p, "path")
    a = words(F.col("wanted"))
    own = F.array_distinct(a)
    overlap = F.when(F.size(own) > 0, F.size(F.array_intersect(own, all_words("t", "s"))) / F.size(own)).otherwise(0.0)
    exact = F.when(F.col("wanted") == F.col("t"), 35).when(F.col("wanted") == F.col("s"), 30).otherwise(0)
    ratio = F.greatest(*[udfs.token_similarity("wanted", c) for c in ("t", "s", "pt")])
    scored = both.withColumn("raw", F.least(ratio * 70 + overlap * 30 + exact, F.lit(100.0))).where(F.col("raw") >= min_score).withColumn("score", F.round("raw", 2))
    at = F.row_number().over(W.partitionBy("title_id").orderBy(F.desc("score"), F.lower("path"), "path"))
    return scored.withColumn("rank", at).where(F.col("rank") <= limit).select("title_id", "rank", "path", "title", "score")


def dead_anchors(pages: DataFrame) -> DataFrame:
    """Links to places of a page that it doesn't have: neither an id nor a heading's slug."""
    body = or_empty("body")
    slugs = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), F.lit(1)), lambda h: F.regexp_replace(F.regexp_replace(F.lower(h), r"[^a-z0-9 \-]", ""), " +", "-"))
    have = F.concat(slugs, F.regexp_extract_all(body, F.lit("id=[\"']([^\"']+)[\"']"), F.lit(1)))
    links = F.regexp_extract_all(body, F.lit(r"\]\(#([^)]+)\)"), F.lit(1))
    return pages.select("path", F.explode(F.array_except(links, have)).alias("anchor"))


def names_entity(entity: Column, title: Column, stem: Column) -> Column:
    """Whether an entity and a page's title or stem name each other."""
    out = F.lit(False)
    for x in (key(title), key(F.regexp_replace(stem, "[-_]", " "))):
        out = out | ((x != "") & (has_phrase(x, key(entity)) | has_phrase(key(entity), x)))
    return (key(entity) != "") & out
