"""Links, viewers, checklist boxes and headings of an HTML page, read as a browser reads them.

Which element holds which text depends on a stack of open elements, which no column
expression keeps; so a page passes one Arrow-batched Python function, once, and everything
after it is column expressions. A page is read in one pass, in time linear in its length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENTS = (
    "struct<clicks:array<struct<pos:int,is_link:boolean,text:string,data_src:string,attr_href:string,onclick:string>>,"
    "viewers:array<struct<pos:int,src:string>>,"
    "boxes:array<struct<name:string,text:string,checked:boolean>>,"
    "headings:array<string>>"
)


def _reader():
    """The page reader as a closure, so that tasks need no copy of this package."""
    import html
    import re
    from collections import Counter
    from html.entities import html5

    attr = r"""[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r"'>][^ \t\n\f\r>]*+)?+)?+"""
    token = re.compile(
        r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # a comment
        rf"|<(/?)([A-Za-z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{attr})*+)(?:>|\Z)"  # a tag
        r"|<[!?/][^>]*+>?",  # a declaration
        re.DOTALL,
    )
    attribute = re.compile(
        r"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\f\r"'>][^ \t\n\f\r>]*+))?+)?+"""
    )
    reference = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|([A-Za-z][A-Za-z0-9]*+)(;?)(?=(=?)))")
    box_name = re.compile(r"check_detail\[[0-9]+\]\[[0-9]+\]")

    # How HTML classes its elements.
    void = set("area base br col embed hr img input link meta param source track wbr".split())
    raw = set("script style iframe noembed noframes noscript xmp textarea title".split())
    formatting = set("a b big code em font i nobr s small strike strong tt u".split())
    table_parts = set("table caption colgroup tbody thead tfoot tr td th".split())
    scope = set("table td th caption html body object applet marquee template".split())
    blocks = set(
        "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split()
    )
    heads = {f"h{n}" for n in range(1, 7)}
    rows = {"td", "th"}
    # A tag on the left ends open elements on the right.
    ends = {
        **{b: {"p"} for b in blocks},
        **{h: {"p", *heads} for h in heads},
        "li": {"li", "p"},
        "dd": {"dd", "dt", "p"},
        "dt": {"dd", "dt", "p"},
        "option": {"option"},
        "a": {"a"},
        "button": {"button"},
        "td": rows,
        "th": rows,
        "tr": {"tr", *rows},
        **{t: {"tbody", "thead", "tfoot", "tr", *rows} for t in ("tbody", "thead", "tfoot")},
    }
    # How far up a start tag looks for what it ends.
    lists = {"li": scope | {"ul", "ol", "menu"}, "dd": scope | {"dl"}, "dt": scope | {"dl"}}
    raw_end = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.IGNORECASE) for name in raw}

    def value(text):
        """An attribute's value; a name without its semicolon counts only at a word's end."""

        def one(m):
            name, semicolon, equals = m.groups()
            if name is None:
                return html.unescape(m.group())
            known = f"{name}{semicolon}" in html5 and not (equals and not semicolon)
            return html.unescape(m.group()) if known else m.group()

        return reference.sub(one, text) if "&" in text else text

    def read(page):
        clicks, viewers, boxes, headings = [], [], [], []
        texts = []
        stack, opened = [("body", 0, [])], Counter()

        def close(depth):
            while len(stack) > depth:
                name, start, waiting = stack.pop()
                opened[name] -= 1
                if waiting:
                    whole = "".join(texts[start:])
                    for record in waiting:
                        record["text"] = whole

        def close_open(names, limit):
            """Close the outermost open element of these names that is within the limit."""
            outermost = 0
            if any(opened[n] > 0 for n in names):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in names:
                        outermost = depth
                    elif stack[depth][0] in limit:
                        break
            if outermost:
                close(outermost)

        def close_last(name, limit):
            if opened[name] > 0:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        close(depth)
                        return
                    if stack[depth][0] in limit:
                        return

        at = 0
        while True:
            m = token.search(page, at)
            end = m.start() if m else len(page)
            if end > at:
                texts.append(html.unescape(page[at:end]))
            if m is None:
                break
            at = m.end()
            if m.group(2) is None:
                continue
            if page[at - 1] != ">":
                break  # a tag that never ends is none
            name = m.group(2).lower()
            if m.group(1):
                if name in table_parts:
                    limit = {"table"} - {name}
                elif name in blocks or name in formatting or name in scope:
                    limit = scope
                else:
                    limit = scope | blocks
                close_last(name, limit)
                continue
            if name in ends:
                close_open(ends[name], lists.get(name, {"table"} if name in table_parts else scope))
            given = {}
            for key, *parts in attribute.findall(m.group(3)):
                given.setdefault(key.lower(), "".join(parts))
            given = {k: value(v) for k, v in given.items()}
            waiting = []
            if name in ("a", "button"):
                record = {"pos": len(clicks), "is_link": name == "a", "text": ""}
                record |= {"data_src": given.get("data-src"), "attr_href": given.get("href"), "onclick": given.get("onclick")}
                clicks.append(record)
                waiting.append(record)
            elif name in heads:
                headings.append({"text": ""})
                waiting.append(headings[-1])
            elif name in ("iframe", "embed", "object"):
                viewers.append({"pos": len(viewers), "src": given.get("src") or given.get("data")})
            elif name == "input" and given.get("type", "").lower() == "checkbox":
                if given.get("name", "").startswith("check_detail") and box_name.search(given["name"]):
                    record = {"name": given["name"], "text": "", "checked": "checked" in given}
                    holder = stack[-1]
                    if opened["label"] > 0:
                        holder = next(e for e in reversed(stack) if e[0] == "label")
                    holder[2].append(record)
                    boxes.append(record)
            if name in void:
                continue
            stack.append((name, len(texts), waiting))
            opened[name] += 1
            if name in raw:
                stop = raw_end[name].search(page, at)
                end = stop.start() if stop else len(page)
                inner = page[at:end]
                texts.append(html.unescape(inner) if name in ("textarea", "title") else inner)
                at = end
        close(0)
        return {
            "clicks": clicks,
            "viewers": viewers,
            "boxes": boxes,
            "headings": [h["text"] for h in headings],
        }

    return read


def _batches():
    read = _reader()
    text, whole, flag = pa.string(), pa.int32(), pa.bool_()
    click = [("pos", whole), ("is_link", flag), ("text", text), ("data_src", text), ("attr_href", text), ("onclick", text)]
    kind = pa.struct(
        [
            ("clicks", pa.list_(pa.struct(click))),
            ("viewers", pa.list_(pa.struct([("pos", whole), ("src", text)]))),
            ("boxes", pa.list_(pa.struct([("name", text), ("text", text), ("checked", flag)]))),
            ("headings", pa.list_(text)),
        ]
    )

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else read(p) for p in pages.to_pylist()], kind)

    return run


def elements(html: Column) -> Column:
    """Clickable elements, viewers, checklist boxes and headings of pages, in page order.

    Comments, scripts and quoted values are not markup; texts are the whole text within an
    element; a box's text is that of the ``label`` around it, else of its parent. Elements
    left open end where HTML ends them.
    """
    return F.arrow_udf(_batches(), ELEMENTS)(html)
