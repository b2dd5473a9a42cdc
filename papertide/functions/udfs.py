"""The few things that no built-in expression can say: Unicode decomposition, HTML entities and trees, sequence similarity, YAML."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .classify import WEAK
from .text import c, key

_NOT_KEY = re.compile("[^a-z0-9]+")


@F.pandas_udf(T.StringType())
def _folded(xs: pd.Series) -> pd.Series:
    return xs.map(lambda x: None if x is None else _NOT_KEY.sub(" ", unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()).strip())


def folded_key(x: Column | str) -> Column:
    """Like key(), but accents are dropped from letters; ASCII text stays in the JVM."""
    x = c(x)
    return F.when(F.regexp_like(x, F.lit(r"^[\x00-\x7F]*$")), key(x)).otherwise(_folded(F.when(~F.regexp_like(x, F.lit(r"^[\x00-\x7F]*$")), x)))


@F.pandas_udf(T.StringType())
def _unescaped(xs: pd.Series) -> pd.Series:
    return xs.map(lambda x: None if x is None else html.unescape(x))


def unescape(x: Column | str) -> Column:
    """HTML entities as characters; text without & stays in the JVM."""
    x = c(x)
    return F.when(F.contains(x, F.lit("&")), _unescaped(F.when(F.contains(x, F.lit("&")), x))).otherwise(x)


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def token_similarity(a: Column | str, b: Column | str) -> Column:
    """Matching words of two texts, by matching blocks, twice over all words; on normalized text."""
    return _similarity(key(c(a)), key(c(b)))


#: Pages that a worker holds as Python values at once.
PAGES = 64


def of_pages(kind: T.DataType) -> Callable:
    """A function of a page as a column function that holds PAGES pages and their results at once, where a plain one holds those of a whole batch of Arrow's; a result is a value of pyarrow's, maps as pairs."""

    def make(f: Callable) -> Callable:
        made = to_arrow_type(kind)

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for at in range(0, max(1, len(batch)), PAGES):
                    yield pa.array([f(x) for x in batch.slice(at, PAGES).to_pylist()], made)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return F.arrow_udf(run, kind)

    return make


class _Tree(HTMLParser):
    """A plain tree of (name, attributes, children); text as strings."""

    VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root: tuple[str, dict, list] = ("", {}, [])
        self.open = [self.root]
        self.feed(source or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, {k: v or "" for k, v in attrs}, [])
        self.open[-1][2].append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1][2].append(data)


def walk(node) -> Iterator:
    for x in node[2]:
        if not isinstance(x, str):
            yield x
            yield from walk(x)


def text_of(node) -> str:
    out: list[str] = []

    def add(x) -> None:
        for y in x[2]:
            if isinstance(y, str):
                out.append(y.strip())
            elif y[0] not in ("script", "style"):
                add(y)

    add(node)
    return " ".join(" ".join(x for x in out if x).split())


def _target(url: str, suffix: str, path: str) -> str:
    try:
        parts = urlparse(url)
    except ValueError:
        return url
    if parts.netloc.endswith(suffix) and parts.path == path:
        inner = parse_qs(parts.query).get("url", [""])[0]
        return unquote(inner) or url
    return url


def _count_authors(authors: str) -> int | None:
    text = authors.replace("…", "")
    if not authors:
        return None
    if "," in text:
        return sum(1 for x in text.split(",") if x.strip())
    if " and " in text.lower():
        return sum(1 for x in re.split(r"\band\b", text, flags=re.I) if x.strip())
    return 1


def _alert(source: str, subject: str, title_class: str, suffix: str, redirect: str) -> list[dict]:
    tree = _Tree(source)
    links = [x for x in walk(tree.root) if x[0] == "a" and "/scholar?q=" in x[1].get("href", "")]
    titles = [x for x in walk(tree.root) if x[0] == "title"]
    bare = lambda x: x.replace("- new results", "").strip()
    alert = text_of(links[0]).strip("[]") if links else (bare(text_of(titles[0])) if titles else "") or "Unknown Alert"
    out: list[dict] = []

    def visit(parent) -> None:
        children = [x for x in parent[2] if not isinstance(x, str)]
        for i, node in enumerate(children):
            if node[0] == "h3":
                read(node, children[i + 1 :])
            visit(node)

    def read(heading, after: list) -> None:
        link = next((x for x in walk(heading) if x[0] == "a" and title_class in x[1].get("class", "").split()), None)
        href = link[1].get("href", "") if link else ""
        if link is None or "scholar_alerts?view_op=" in href or not text_of(link):
            return
        label = next((text_of(x) for x in walk(heading) if x[0] == "span"), "")
        divs = [x for x in after if x[0] == "div"]
        info, snippet = (text_of(divs[k]) if len(divs) > k else "" for k in (0, 1))
        block = []
        for x in after:
            if x[0] == "h3":
                break
            block.append(x)
        anchors = (a for x in block if x[0] == "div" for a in walk(x) if a[0] == "a" and "href" in a[1])
        pdf = next((u for a in anchors if (u := _target(a[1]["href"], suffix, redirect)).lower().endswith(".pdf")), None)
        authors = info.split(" - ", 1)[0].strip()
        out.append({"alert_name": alert or bare(subject or ""), "title": text_of(link), "authors": authors, "publication_info": info, "snippet": snippet, "scholar_url": href, "article_url": _target(href, suffix, redirect), "pdf_url": pdf, "format_label": label.strip("[]") if label.startswith("[") and label.endswith("]") else None, "author_count": _count_authors(authors)})

    visit(tree.root)
    return out


CANDIDATES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n == "author_count" else T.StringType()) for n in ("alert_name", "title", "authors", "publication_info", "snippet", "scholar_url", "article_url", "pdf_url", "format_label", "author_count")]))


@F.udf(CANDIDATES, useArrow=True)
def alert_candidates(source: str, subject: str) -> list[dict]:
    """The candidates of an alert e-mail: a heading with a title link, then its details and snippet."""
    return _alert(source or "", subject or "", "gse_alrt_title", "scholar.google.com", "/scholar_url")


@F.udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("tags_is_list", T.BooleanType()), T.StructField("permalink", T.StringType()), T.StructField("error", T.StringType()), T.StructField("extra", T.StringType())]), useArrow=True)
def front_matter(text: str) -> dict | None:
    """Title, tags and permalink of a page's front matter; `error` if it is no YAML mapping; the rest as JSON."""
    if text is None:
        return None
    import yaml

    try:
        data = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        return {"error": str(e)}
    if not isinstance(data, dict):
        return {"error": "frontmatter is not a YAML mapping"}
    tags = data.get("tags")
    as_text = lambda x: None if x is None else str(x)
    listed = [str(x) for x in tags] if isinstance(tags, list) else [tags] if isinstance(tags, str) and tags.strip() else []
    return {"title": as_text(data.get("title")), "tags": listed, "tags_is_list": None if tags is None else isinstance(tags, list), "permalink": as_text(data.get("permalink")), "extra": json.dumps({k: v for k, v in data.items() if k not in ("title", "tags", "permalink") and v not in (None, "", [])}, default=str, sort_keys=True)}


@F.udf(T.StringType(), useArrow=True)
def message_html(raw: str) -> str:
    """The first part with text of a mail message, depth first: a node's own HTML, then its parts, then its own plain text."""
    import base64

    def read(node: dict) -> str:
        data, kind = (node.get("body") or {}).get("data"), node.get("mimeType", "")
        decoded = lambda: base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", errors="replace")
        if kind == "text/html" and data:
            return decoded()
        for part in node.get("parts") or []:
            if found := read(part):
                return found
        return decoded() if kind == "text/plain" and data else ""

    try:
        return read((json.loads(raw or "{}") or {}).get("payload") or {})
    except ValueError:
        return ""


@F.udf(T.MapType(T.StringType(), T.StringType()), useArrow=True)
def message_headers(raw: str) -> dict:
    """Headers by lower-case name; of repeated ones the last."""
    try:
        headers = ((json.loads(raw or "{}") or {}).get("payload") or {}).get("headers") or []
    except ValueError:
        return {}
    return {x.get("name", "").lower(): x.get("value", "") for x in headers}


#: Where a page's text may stand, in order, and what is never part of it; texts of fewer characters are only taken if there is no better one.
CONTENT = (".html-body", "article", ".article-content", ".article-body", "[role=main]", "main", ".post-content", ".entry-content", "#content", ".main-content")
UNWANTED = ("nav", "header", "footer", "script", "style", ".sidebar", ".comments", ".social-share", ".related-posts", ".advertisement", ".navigation", ".menu", ".widget", ".header", ".footer", ".author-bio", ".newsletter-signup", ".subscription-box", ".article-notes")
UNWANTED_PARTS = ("cookie", "banner", "popup")
LEAST_BODY = 800
_WEAK = tuple(re.compile(p) for p in WEAK.values())


def _fits(node, selector: str) -> bool:
    tag, attrs = node[0], node[1]
    if selector[0] == ".":
        return selector[1:] in attrs.get("class", "").split()
    if selector[0] == "#":
        return attrs.get("id") == selector[1:]
    if selector[0] == "[":
        name, value = selector[1:-1].split("=")
        return attrs.get(name) == value
    return tag == selector


def _without_unwanted(node):
    """The tree without what is never part of a text."""
    out = []
    for x in node[2]:
        if isinstance(x, str):
            out.append(x)
        elif not (any(_fits(x, s) for s in UNWANTED) or any(p in x[1].get(a, "") for p in UNWANTED_PARTS for a in ("class", "id")) or (x[0] == "figcaption" and node[0] == "figure")):
            out.append(_without_unwanted(x))
    return node[0], node[1], out


def best_body(root) -> str:
    """The text of the first place that has enough of it, else the best one; signs of a page that isn't the article count against a text."""
    root = _without_unwanted(root)
    nodes = list(walk(root))
    best, most = "", -1
    for selector in (*CONTENT, "body", None):
        node = root if selector is None else next((x for x in nodes if _fits(x, selector)), None)
        if node is None:
            continue
        text = text_of(node)
        score = len(text) - 1000 * sum(1 for p in _WEAK if p.search(text.lower())) if text else 0
        if selector in CONTENT and score >= LEAST_BODY:
            return text
        if score > most:
            best, most = text, score
    return best


def selector_texts(source: str, selector: str) -> list[str]:
    """The distinct texts of the nodes that a tag, class, id or attribute names."""
    found = (text_of(x) for x in walk(_Tree(source).root) if _fits(x, selector))
    return list(dict.fromkeys(x for x in found if x))


@of_pages(T.StructType([T.StructField("title", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("metas", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("body", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))]))
def page_parts(source: str) -> dict | None:
    """Title, first heading, meta values by name, the text of the best body and the links of an HTML page."""
    if source is None:
        return None
    tree = _Tree(source)
    metas: dict[str, list[str]] = {}
    for x in walk(tree.root):
        if x[0] == "meta" and (name := (x[1].get("name") or x[1].get("property") or "").lower()):
            metas.setdefault(name, []).append(" ".join(x[1].get("content", "").split()))
    first = lambda tag: next((text_of(x) for x in walk(tree.root) if x[0] == tag), "")
    out = {"title": first("title"), "heading": first("h1"), "metas": list(metas.items()), "links": [x[1]["href"] for x in walk(tree.root) if x[0] == "a" and "href" in x[1]]}
    return out | {"body": best_body(tree.root)}
