"""Markdown of HTML: the stack machine against a recursive rendering of the tree, and by example."""

import random

import pytest

from papertide.functions import markdown, udfs
from papertide.functions.markdown import Frame

TAGS = ("p", "div", "b", "i", "a", "ul", "ol", "li", "blockquote", "pre", "h2", "h3", "span", "table", "tr", "td", "th", "code", "article", "nav", "script")


def page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.45 or depth > 5:
            out.append(rng.choice(["word", " two  words ", "\n", "a &amp; b", "x|y", " "]))
        elif kind < 0.55:
            out.append(rng.choice(["<br>", "<hr>", '<img src="i.png" alt="pic">', "<br/>"]))
        else:
            tag = rng.choice(TAGS)
            named = {"a": ' href="u"', "ol": ' start="4"', "div": rng.choice(["", ' class="sidebar"', ' id="content"'])}.get(tag, "")
            closing = f"</{tag}>" if rng.random() < 0.85 else ""
            out.append(f"<{tag}{named}>{page(rng, depth + 1)}{closing}")
    return "".join(out)


def by_tree(source):
    """The same rules over a tree, from the leaves up."""

    def unwanted(node, parent):
        tag, attrs, _ = node
        return tag in markdown.SILENT or any(udfs._fits(node, s) for s in udfs.UNWANTED) or any(x in attrs.get(a, "") for x in udfs.UNWANTED_PARTS for a in ("class", "id")) or (tag == "figcaption" and parent[0] == "figure")

    def parts_of(node):
        out = []
        for x in node[2]:
            if isinstance(x, str):
                out.append(("run", x))
            elif not unwanted(x, node):
                if x[0] == "br":
                    out.append(("run", "\0"))
                elif x[0] == "hr":
                    out.append(("block", "---"))
                elif x[0] == "img":
                    out.append(("run", f"![{x[1].get('alt', '')}]({x[1]['src']})" if x[1].get("src") else ""))
                elif x[0] not in markdown.VOID:
                    frame = Frame(x[0], x[1], False)
                    frame.parts = parts_of(x)
                    out += markdown.close(frame)
        return out

    return "\n\n".join(markdown.blocks_of(parts_of(udfs._Tree(source).root)))


@pytest.mark.parametrize("seed", range(40))
def test_stack_machine_equals_the_tree(seed):
    rng = random.Random(seed)
    for _ in range(25):
        source = page(rng)
        assert markdown.markdown(source) == by_tree(source), source


def test_markdown_by_example():
    assert markdown.markdown("<h1>A <b>b</b></h1><p>x <i> y </i>z <a href='u'>l <b>k</b></a><br>w</p>") == "# A **b**\n\nx *y* z [l **k**](u)\nw"
    assert markdown.markdown("<ul><li>one<ul><li>in</li></ul></li><li>two</li></ul><ol start=3><li>c</li><li>d</li></ol>") == "- one\n  - in\n- two\n\n3. c\n4. d"
    assert markdown.markdown("<pre>a\n b</pre><blockquote><p>q</p><p>r</p></blockquote>") == "```\na\n b\n```\n\n> q\n>\n> r"
    assert markdown.markdown("<table><tr><th>h|1</th><td>2</td></tr><tr><td>3</td></tr></table>") == "| h\\|1 | 2 |\n| --- | --- |\n| 3 |  |"
    assert markdown.markdown("<p><b>open<br><p>in</p>") == "open\n\nin" and markdown.markdown("<p><b>last.<br></p>") == "**last.**"
    assert markdown.markdown("") == "" == markdown.markdown("<nav>menu</nav><script>x</script><p> </p>") and markdown.markdown(None) == ""
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert markdown.markdown(deep) == "x"


def test_the_best_body():
    long = "<p>" + "word " * 200 + "</p>"
    assert markdown.body_markdown(f"<body><p>no</p><main>{long}</main></body>") == (("word " * 200).strip(), "main")
    assert markdown.body_markdown("<body><article>short</article><p>and more</p></body>") == ("short\n\nand more", "body")
    assert markdown.body_markdown("plain") == ("plain", "document")


def test_columns(spark):
    df = spark.createDataFrame([("<div class='x'>a</div><div class='x'>a</div><p class='x'>b</p>",), (None,)], "html string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(markdown.selected_texts("html", F.lit(".x"))).collect()] == [["a", "b"], None]
    assert [tuple(r[0]) if r[0] else None for r in df.select(markdown.page_markdown("html")).collect()] == [("a\n\na\n\nb", "document"), None]
