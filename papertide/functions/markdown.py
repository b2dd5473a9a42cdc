"""HTML as Markdown by a stack machine: one pass over a page's tags, with a frame for each open element and no tree.

A frame holds what its element has come to so far: runs of inline text and finished blocks. A closing tag pops the frames up to its own, each
of which becomes a run or a block of the one below; tags that are never closed end with what holds them. Places where a page's text may stand are rendered
on the way, each as its element closes, and the best one is taken as the body.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .udfs import _WEAK, CONTENT, LEAST_BODY, UNWANTED, UNWANTED_PARTS, _fits, of_pages

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
HEADINGS = {f"h{i}": i for i in range(1, 7)}
INLINE = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "tt": "`", "del": "~~", "s": "~~"}
#: Elements that stand on lines of their own; others are part of their line.
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form header html main nav noscript p pre section summary table tbody td tfoot th thead tr ul ol li".split()) | HEADINGS.keys()
#: What says nothing where it stands.
SILENT = frozenset(("script", "style", "title", "head", "template", "noscript"))
#: A break of the line inside of a run.
_BREAK = "\0"
_SPACE = " \t\r\n\f\u00a0" + _BREAK


class Frame:
    __slots__ = ("tag", "attrs", "parts", "silent", "places")

    def __init__(self, tag: str, attrs: dict[str, str], silent: bool, places: tuple[str, ...] = ()) -> None:
        #: parts: (kind, text), where kind is run, block, item, cell or row.
        self.tag, self.attrs, self.parts, self.silent, self.places = tag, attrs, [], silent, places


def line(text: str) -> str:
    """A run of inline text: white space is one space, but for breaks."""
    found = [" ".join(x.split()) for x in text.split(_BREAK)]
    return "\n".join(found).strip("\n ")


def run_of(parts: list[tuple[str, str]]) -> str:
    return "".join(t for k, t in parts if k == "run")


def blocks_of(parts: list[tuple[str, str]]) -> list[str]:
    """Paragraphs out of runs, and the blocks between them."""
    out, run = [], []

    def flush() -> None:
        if text := line("".join(run)):
            out.append(text)
        run.clear()

    for kind, text in parts:
        if kind == "run":
            run.append(text)
        else:
            flush()
            if text:
                out.append(text)
    flush()
    return out


def _wrapped(text: str, mark: str) -> str:
    """Marks stand at words, and not at the white space and breaks around them."""
    inner = text.strip(_SPACE)
    return text if not inner else text[: len(text) - len(text.lstrip(_SPACE))] + mark + inner + mark + text[len(text.rstrip(_SPACE)) :]


def _indented(text: str, by: str) -> str:
    return "\n".join(by + x if x else x for x in text.split("\n"))


def _listed(frame: Frame) -> str:
    out, n = [], int(frame.attrs.get("start", "")) if frame.attrs.get("start", "").isdigit() else 1
    for kind, text in frame.parts:
        if kind == "run":
            text = line(text)
        if not text:
            continue
        mark = f"{n}. " if frame.tag == "ol" else "- "
        n += 1
        out.append(mark + _indented(text, " " * len(mark))[len(mark) :])
    return "\n".join(out)


def _table(frame: Frame) -> str:
    rows = [t.split(_BREAK) for k, t in frame.parts if k == "row"]
    if not rows:
        return "\n\n".join(blocks_of(frame.parts))
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def close(frame: Frame) -> list[tuple[str, str]]:
    """What an element is for the frame below."""
    tag, parts = frame.tag, frame.parts
    whole = all(k == "run" for k, _ in parts)
    if tag in HEADINGS:
        text = line(" ".join(t for _, t in parts)).replace("\n", " ")
        return [("block", "#" * HEADINGS[tag] + " " + text)] if text else []
    if tag in INLINE or tag == "a":
        if not whole:  # around blocks there is nothing to mark
            return parts
        text = run_of(parts)
        if tag != "a":
            return [("run", _wrapped(text, INLINE[tag]))]
        href = frame.attrs.get("href", "")
        shown = line(text).replace("\n", " ")
        return [("run", f"[{shown}]({href})" if shown and href else text)]
    if tag == "li":
        return [("item", "\n".join(blocks_of(parts)))]
    if tag in ("ul", "ol"):
        return [("block", _listed(frame))]
    if tag == "blockquote":
        return [("block", "\n".join(("> " + x).rstrip() for x in "\n\n".join(blocks_of(parts)).split("\n")) if parts else "")]
    if tag == "pre":
        text = "".join(t for _, t in parts).replace(_BREAK, "\n").strip("\n")
        return [("block", f"```\n{text}\n```")] if text.strip() else []
    if tag in ("td", "th"):
        return [("cell", " ".join(" ".join(blocks_of(parts)).split()).replace("|", "\\|"))]
    if tag == "tr":
        return [("row", _BREAK.join(t for k, t in parts if k == "cell"))]
    if tag in ("thead", "tbody", "tfoot"):
        return parts
    if tag == "table":
        return [("block", _table(frame))]
    return [("block", "\n\n".join(blocks_of(parts)))] if tag in BLOCKS else parts


class Machine(HTMLParser):
    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.frames = [Frame("", {}, False)]
        self.seen: set[str] = set()
        self.bodies: dict[str, str] = {}
        self.feed(source or "")
        self.close()
        while len(self.frames) > 1:
            self.pop()
        self.bodies[""] = "\n\n".join(blocks_of(self.frames[0].parts))

    def unwanted(self, tag: str, attrs: dict[str, str]) -> bool:
        node = (tag, attrs, [])
        return tag in SILENT or any(_fits(node, s) for s in UNWANTED) or any(p in attrs.get(a, "") for p in UNWANTED_PARTS for a in ("class", "id")) or (tag == "figcaption" and self.frames[-1].tag == "figure")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        top, named = self.frames[-1], {k: v or "" for k, v in attrs}
        silent = top.silent or self.unwanted(tag, named)
        if tag in VOID:
            if not silent:
                kind, text = {"br": ("run", _BREAK), "hr": ("block", "---"), "img": ("run", f"![{named.get('alt', '')}]({named['src']})" if named.get("src") else "")}.get(tag, ("run", ""))
                top.parts.append((kind, text))
            return
        places = () if silent else tuple(s for s in (*CONTENT, "body") if s not in self.seen and _fits((tag, named, []), s))
        self.seen.update(places)
        self.frames.append(Frame(tag, named, silent, places))

    def handle_endtag(self, tag: str) -> None:
        if any(f.tag == tag for f in self.frames[1:]):
            while self.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.frames[-1].silent:
            self.frames[-1].parts.append(("run", data.replace(_BREAK, "")))

    def pop(self) -> str:
        frame = self.frames.pop()
        if not frame.silent:
            for place in frame.places:
                self.bodies[place] = "\n\n".join(blocks_of(frame.parts))
            self.frames[-1].parts += close(frame)
        return frame.tag


def markdown(source: str) -> str:
    """A whole page, without what is never part of a text."""
    return Machine(source).bodies[""]


def body_markdown(source: str) -> tuple[str, str]:
    """The first place that has enough text, else the best one, and its name; signs of a page that isn't the article count against a text."""
    bodies = Machine(source).bodies
    best, label, most = "", "document", -1
    for place in (*CONTENT, "body", ""):
        if place not in bodies:
            continue
        plain = " ".join(bodies[place].split())
        score = len(plain) - 1000 * sum(1 for p in _WEAK if p.search(plain.lower())) if plain else 0
        if place in CONTENT and score >= LEAST_BODY:
            return bodies[place], place
        if score > most:
            best, label, most = bodies[place], place or "document", score
    return best, label


@of_pages(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("place", T.StringType())]))
def page_markdown(source: str) -> dict | None:
    """The body of an HTML page as Markdown, and where it stands."""
    if source is None:
        return None
    text, place = body_markdown(source)
    return {"markdown": text, "place": place}


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def selected_texts(source: str, selector: str) -> list[str] | None:
    """The distinct texts of the nodes that a tag, class, id or attribute names: the column form of udfs.selector_texts."""
    from .udfs import selector_texts

    return None if source is None else selector_texts(source, selector)
