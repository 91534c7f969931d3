"""Converted papers as trees: typed blocks with captions, formulas, lists, references and the files they show."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.cleanup import compact_label
from papyra.functions.texmath import normal_math
from papyra.sources.html import VOID, pieces

#: Keys of options that lay out authors (fixed values).
LAYOUT_KEYS = ("affiliation", "affiliationid", "auid", "bioid", "collab", "corref", "credit", "degree", "ead", "email", "fnref", "orcid", "prefix", "role", "suffix", "type")
#: Tags whose start ends an open paragraph, as the HTML standard has it.
ENDS_PARAGRAPH = {"p", "ul", "ol", "dl", "div", "table", "figure", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "footer", "pre"}
#: Class names, in lower case, by what they mark (fixed values).
MARKS = {
    "navigation": ("ltx_toc", "ltx_list_toc", "ltx_list_lot", "ltx_list_lof"),
    "list": ("ltx_itemize", "ltx_enumerate", "ltx_description"),
    "equation": ("ltx_equation", "ltx_eqn_table", "ltx_eqn_align"),
    "algorithm": ("ltx_algorithm", "ltx_float_algorithm"),
}
#: Prefixes of block ids and the width of their numbers (fixed values).
IDS = {"section": ("sec", 3), "paragraph": ("p", 4), "equation": ("eq", 4), "figure": ("fig", 4), "table": ("tbl", 4), "algorithm": ("alg", 4), "list": ("lst", 4)}
#: Where an image's file is named, the first that is given (fixed values).
FILE_KEYS = ("src", "data", "href", "xlink:href")
#: Drawing code, the first that is found, by what betrays it (fixed values).
DRAWN = (("pgfplots", ("pgfplots", "axis}")), ("tikz", ("tikz",)), ("pstricks", ("pstricks", "pspicture")))
#: Prefixes that attributes of these namespaces go by (fixed values).
PREFIXES = {"http://www.w3.org/1999/xlink": "xlink", "http://www.w3.org/XML/1998/namespace": "xml"}
#: Elements that inline() reads as a whole.
WHOLE = ("math", "br", "script", "style", "annotation")
INLINE = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
OPTION = re.compile(r"^\s*([A-Za-z][\w-]*)\s*=")
#: What HTML and XML read differently, though it be well formed: paragraphs, which end by themselves, declarations, names of characters, raw text, line ends and tabs in tags, capitals and prefixes in names (fixed values).
BY_HTML = re.compile(r"[&\r\0]|<(?:[!?]|/?(?:p|script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext|math|svg)\b|[^<>]*[\n\t\f]|/?[a-z0-9-]*[^a-z0-9\s/>-])|<[^<>]*\s[^\s\"=<>]*[^a-z0-9\s\"=<>/-][^\s\"=<>]*=")
#: An empty element that is left open.
OPEN_VOID = re.compile(rf"""<((?:{"|".join(sorted(VOID))})(?:\s+[a-z][a-z0-9-]*="[^"<>]*")*)\s*>""")
#: The sign that begins a character's name or number which no semicolon ends.
OPEN_NAME = re.compile(r"&(?=(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+)(?![A-Za-z0-9;]))")
CAPTION_KIND = re.compile(r"\s*(table|algorithm|figure)\s+\d+", re.I)
CAPTION_TAG = re.compile(r"^\s*(?:figure|fig\.|table|algorithm|alg\.)\s+\d+[.:]\s*", re.I)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.count = ET.TreeBuilder(), ["document"], Counter()
        self.out.start("document", {})

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag in ENDS_PARAGRAPH and self.count["p"]:
            self.handle_endtag("p")
        self.out.start(tag, {k: v or "" for k, v in attributes})
        if tag in VOID:
            self.out.end(tag)
        else:
            self.open.append(tag)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:
            top = None
            while top != tag:
                top = self.open.pop()
                self.count[top] -= 1
                self.out.end(top)

    def handle_data(self, data: str) -> None:
        self.out.data(data)

    def tree(self) -> ET.Element:
        while self.open:
            self.out.end(self.open.pop())
        return self.out.close()


def tree_of(html: str | None, closed: bool = False) -> ET.Element:
    """A page as a tree under one root; whatever is left open is closed, and closing tags without an opening one are passed over.

    closed: names of characters count only with their semicolon; else those that browsers read without one count too.
    """
    builder = _Builder()
    builder.feed(OPEN_NAME.sub("&amp;", html or "") if closed else html or "")
    builder.close()
    return builder.tree()


def xml_tree(text: str | None) -> ET.Element | None:
    """A well-formed document as a tree of local names, its attributes with the usual prefixes; None for any other text."""
    try:
        root = ET.fromstring(text or "")
    except (ET.ParseError, ValueError):  # what isn't XML, and declarations that contradict the text
        return None
    if "xmlns" not in text and "xml:" not in text:  # no name has a namespace
        return root
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
        for key in [k for k in e.attrib if k.startswith("{")]:
            space, _, name = key[1:].partition("}")
            e.set(f"{PREFIXES[space]}:{name}" if space in PREFIXES else name, e.attrib.pop(key))
    return root


def page_tree(text: str | None, closed: bool = False) -> ET.Element:
    """A page read as XML where it is well formed, else as HTML (closed: as tree_of() has it).

    HTML whose only departure from XML is that empty elements are left open is read by the XML parser too, with these closed:
    it is much faster, and the tree is the same unless the text has what the two read differently (BY_HTML).
    """
    root = xml_tree(text)
    if root is None and text and not BY_HTML.search(text):
        root = xml_tree(OPEN_VOID.sub(r"<\1/>", text))
    return tree_of(text, closed) if root is None else root


def classes(e: ET.Element) -> str:
    return e.get("class", "").lower()


def classed(e: ET.Element) -> Iterator[ET.Element]:
    """The elements of a tree that have classes."""
    return (x for x in e.iter() if x.get("class"))


def marked(e: ET.Element, mark: str) -> bool:
    names = e.get("class")
    return bool(names) and any(m in names.lower() for m in MARKS[mark])


def plain(e: ET.Element) -> str:
    """An element's text with single blanks."""
    return " ".join("".join(e.itertext()).split())


def tex_of(e: ET.Element) -> str | None:
    """A formula's TeX: its annotation, else its alternative text."""
    noted = (plain(a) for a in e.iter("annotation") if "tex" in a.get("encoding", "").lower())
    return next((t for t in map(normal_math, noted) if t), None) or normal_math(e.get("alttext") or e.get("tex")) or None


def formulas(e: ET.Element) -> str | None:
    """The TeX of every formula in an element: by table rows, which are aligned where there are several, else in a line."""
    found = lambda part: [t for t in map(tex_of, part.iter("math")) if t]
    rows = [" ".join(line) for line in map(found, e.iter("tr")) if line]
    if not rows:
        return " ".join(found(e)) or None
    return rows[0] if len(rows) == 1 else "\\begin{aligned}\n" + " \\\\\n".join(rows) + "\n\\end{aligned}"


def _whole(x: ET.Element) -> str:
    """What an element of WHOLE becomes within a line."""
    if x.tag != "math":
        return " " if x.tag == "br" else ""
    tex = tex_of(x)
    return "$" + tex.replace("$", r"\$") + "$" if tex else plain(x)


#: Marks and tags of notes, which readers don't see within a line, and notes at the foot, which they read in brackets (fixed values).
NOTE_MARKS, FOOTNOTE = ("ltx_note_mark", "ltx_tag_note"), "ltx_role_footnote"
#: Citations that nothing in the bibliography answers (fixed values).
UNANSWERED = ("ltx_missing_citation", "ltx_ref_self")


def _cited(x: ET.Element, inside: str) -> str:
    """A citation without the brackets around its links, or in brackets where the bibliography has no answer."""
    text = " ".join(inside.split())
    bare = text[1:-1].strip() if text.startswith("[") and text.endswith("]") else text
    if any(a.get("href", "").startswith("#bib.") for a in x.iter("a")):
        return bare if not bare.startswith("[") or text.startswith("[[") else inside
    if not any(m in classes(e).split() for e in x.iter() for m in UNANSWERED) or not bare:
        return inside
    return "[" + re.sub(r"([,;:])(?=\S)", r"\1 ", re.sub(r"\s+([,.;:])", r"\1", bare)) + "]"


def _wrapped(x: ET.Element, inside: str) -> str:
    """An element's inline content with its marks."""
    text, names = " ".join(inside.split()), classes(x).split()
    if any(m in names for m in NOTE_MARKS):
        return ""
    if FOOTNOTE in names:
        return f" ({text.removesuffix('.').strip()})" if text else ""
    if x.tag == "cite":
        return _cited(x, inside)
    if text and x.tag == "a" and x.get("href"):
        label = text[1:-1] if text.startswith("[") and text.endswith("]") else text
        label = compact_label(label) if x.get("href").startswith("#bib.") else label
        return f"[{label}]({x.get('href')})"
    return INLINE[x.tag] + text + INLINE[x.tag] if text and x.tag in INLINE else inside


def inline(e: ET.Element) -> str:
    """An element's content as Markdown on one line: emphasis, code, links and formulas. Depth doesn't matter: elements wait on a list, not on the call stack."""
    waiting, text = [(e, [e.text or ""], iter(e))], _whole(e)
    while waiting and e.tag not in WHOLE:
        x, parts, children = waiting[-1]
        c = next(children, None)
        if c is None:
            waiting.pop()
            text = "".join(parts)
            if waiting:
                waiting[-1][1].extend((_wrapped(x, text), x.tail or ""))
        elif c.tag in WHOLE:
            parts.extend((_whole(c), c.tail or ""))
        else:
            waiting.append((c, [c.text or ""], iter(c)))
    text = " ".join(text.split())
    for bracket in "])":
        text = text.replace(f" {bracket}", bracket)
    for bracket in "[(":
        text = text.replace(f"{bracket} ", bracket)
    return re.sub(r"\s+([,.;:])", r"\1", text)


def references(e: ET.Element) -> list[dict]:
    """href, text of each link of an element."""
    return [{"href": a.get("href"), "text": plain(a)} for a in e.iter("a") if a.get("href")]


def files(e: ET.Element) -> list[str]:
    """Names of the files an element shows, in order."""
    named = (next((x.get(k).strip() for k in FILE_KEYS if x.get(k)), None) for x in e.iter() if x.tag in ("img", "image", "object"))
    return [n for n in named if n]


def drawn(e: ET.Element) -> str | None:
    """The kind of drawing code that an element stands for, if any."""
    keys = ("class", "data-render-kind", "alttext")
    hay = " ".join([x.get(k, "") for x in e.iter() for k in keys] + [plain(e)]).lower()
    return next((kind for kind, signs in DRAWN if any(s in hay for s in signs)), None)


def captions(parts: Iterator[ET.Element]) -> Iterator[str]:
    return (t for t in (inline(x) for x in parts if x.tag in ("figcaption", "caption") or "caption" in classes(x)) if t)


def caption_of(e: ET.Element) -> str | None:
    """An element's caption without its number and without emphasis around it."""
    text = next(captions(e.iter()), None)
    if text is None:
        return None
    text = CAPTION_TAG.sub("", text).strip()
    around = next((m for m in ("**", "*", "__", "_") if text.startswith(m) and text.endswith(m) and len(text) > 2 * len(m)), "")
    return text[len(around) : len(text) - len(around)].strip()


def is_algorithm(e: ET.Element) -> bool:
    if e.tag not in ("figure", "table", "div"):
        return False
    numbered = CAPTION_KIND.match(next(captions(iter(e)), ""))
    return marked(e, "algorithm") or "algorithm" in classes(e).split() or bool(numbered and numbered[1].lower() == "algorithm")


def float_kind(e: ET.Element) -> str:
    """What a figure element holds: by its own classes, then by its caption's tag, then by the caption's first word."""
    if "ltx_table" in classes(e):
        return "table"
    for x in classed(e):
        if "ltx_tag_" in classes(x):
            for kind in ("algorithm", "table", "figure"):
                if f"ltx_tag_{kind}" in classes(x):
                    return kind
    named = CAPTION_KIND.match(next(captions(e.iter()), ""))
    return named[1].lower() if named else "figure"


def is_list(e: ET.Element) -> bool:
    return "ltx_biblist" not in classes(e) and (e.tag in ("ul", "ol", "dl") or marked(e, "list"))


def is_item(e: ET.Element) -> bool:
    return "ltx_bibitem" not in classes(e) and (e.tag in ("li", "dt", "dd") or "ltx_item" in classes(e).split())


def list_kind(e: ET.Element) -> str:
    ordered, described = e.tag == "ol" or "ltx_enumerate" in classes(e), e.tag == "dl" or "ltx_description" in classes(e)
    return "ordered" if ordered else "description" if described else "unordered"


def list_markdown(e: ET.Element) -> str:
    """A list as Markdown lines; lists inside of items are indented, and markers of items aren't repeated."""
    lines, todo = [], [(e, 0, 0)]  # lists, and items with their number
    while todo:
        x, depth, number = todo.pop()
        if not number:
            ordered = list_kind(x) == "ordered"
            todo.extend(reversed([(item, depth, n if ordered else -1) for n, item in enumerate(filter(is_item, x), 1)]))
            continue
        own, inner = ET.Element("item"), [c for c in x if is_list(c)]
        own.text = x.text
        for c in x:
            kept = ET.SubElement(own, "span")
            kept.tail = c.tail
            if not (is_list(c) or "ltx_tag_item" in classes(c) or "ltx_itemmarker" in classes(c)):
                copy = ET.SubElement(kept, c.tag, c.attrib)
                copy.text, copy[:] = c.text, list(c)
        lines.append(f"{'  ' * depth}{f'{number}.' if number > 0 else '-'} {inline(own)}".rstrip())
        todo.extend((c, depth + 1, 0) for c in reversed(inner))
    return "\n".join(lines)


def is_layout_note(text: str, keys: frozenset[str]) -> bool:
    """Whether a paragraph is nothing but [key=value, ...] options with keys that lay out authors."""
    groups = re.findall(r"\[([^\[\]]+)\]", text)
    if not groups or re.sub(r"\[[^\[\]]+\]", "", text).strip():
        return False
    named = [OPTION.match(option) for g in groups for option in re.split(r",\s*(?=[A-Za-z][\w-]*\s*=)", g) if option.strip()]
    return all(m and m[1].lower() in keys for m in named)


def kind_of(e: ET.Element) -> str | None:
    """The kind of block an element becomes as a whole; None where its children are looked at."""
    equation = lambda: any(marked(x, "equation") for x in classed(e))
    if is_algorithm(e):
        return "algorithm"
    if is_list(e):
        return "list"
    if re.fullmatch("h[1-6]", e.tag):
        return "section"
    if e.tag == "p":
        return "paragraph"
    if e.tag == "math" and e.get("display") == "block" or e.tag in ("figure", "table") and equation():
        return "equation"
    return float_kind(e) if e.tag == "figure" else "table" if e.tag == "table" else None


def tops(root: ET.Element) -> Iterator[tuple[str, ET.Element]]:
    """(kind, element) of each block in document order; generated tables of contents are left out."""
    todo = [root]
    while todo:
        e = todo.pop()
        if e.tag in ("nav", "div", "section", "ol", "ul") and marked(e, "navigation") or e.tag in ("head", "script", "style"):
            continue
        kind = kind_of(e)
        if kind:
            yield kind, e
        else:
            todo.extend(reversed(e))


COLUMNS = "place long, block_uid string, block_type string, level int, label string, text string, items int, list_kind string, numbers array<string>, files array<string>, drawn string, refs array<struct<href: string, text: string>>"
TYPES = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))]


def blocks_of(html: str | None, layout_keys: frozenset[str] = frozenset(), closed: bool = False) -> Iterator[tuple]:
    """The blocks of a page, as COLUMNS has them. Blocks without text are left out, and an environment without one is named by its kind."""
    counts, place = Counter(), 0
    for kind, e in tops(page_tree(html, closed)):
        level = items = shape = code = None
        numbers, shown = [], []
        if kind == "list":
            text, items, shape = list_markdown(e), sum(map(is_item, e)), list_kind(e)
        elif kind == "section":
            text, level = plain(e), int(e.tag[1])
        elif kind == "paragraph":
            text = inline(e)
        elif kind == "equation":
            text = formulas(e) or plain(e)
            numbers = list(dict.fromkeys(filter(None, (plain(x) for x in e.iter() if {"ltx_eqn_eqno", "ltx_tag_equation"} & set(classes(x).split())))))
        else:
            shown = files(e)
            code = None if shown else drawn(e)
            text = f"**{kind.title()} {counts[kind] + 1}.** {caption_of(e) or plain(e) or f'{kind.title()} {counts[kind] + 1}'}"
        if not text:
            continue
        counts[kind] += 1
        if kind == "paragraph" and is_layout_note(text, layout_keys):
            continue  # it has a number, but is no block
        place += 1
        prefix, width = IDS[kind]
        links = references(e) if kind in ("list", "paragraph") else []
        label = None if kind in ("list", "paragraph") else e.get("id") or e.get("label") or None
        yield place, f"{prefix}-{counts[kind]:0{width}}", kind, level, label, text, items, shape, numbers, shown, code, links


def document_blocks(pages: DataFrame, id_col: str, html_col: str, layout_keys: tuple[str, ...] = LAYOUT_KEYS, closed: bool = False) -> DataFrame:
    """id and COLUMNS of each block of converted papers, a page parsed in one call; nothing is shuffled.

    Ids number blocks of a kind within a page. layout_keys: options that lay out authors; paragraphs of nothing else are
    left out. Null and empty pages have no blocks; pages with the same id are parsed each for itself. closed: names of
    characters count only with their semicolon.
    """
    keys = frozenset(k.lower() for k in layout_keys)
    names = [c.split()[0] for c in re.sub("<[^,]*, [^,]*>>", "", COLUMNS).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            rows = [(at, *block) for at, html in enumerate(part.column(1).to_pylist()) for block in blocks_of(html, keys, closed)]
            at, *rest = zip(*rows, strict=True) if rows else [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, kind) for x, kind in zip(rest, TYPES, strict=True))], ["papyra_key", *names])

    kind = pages.schema[id_col].dataType.simpleString()
    found = pages.select(F.col(id_col).alias("papyra_key"), F.col(html_col).alias("papyra_html")).mapInArrow(run, f"papyra_key {kind}, {COLUMNS}")
    return found.withColumnRenamed("papyra_key", id_col)


def located(targets: DataFrame, blocks: DataFrame, id_col: str, target: str) -> DataFrame:
    """The rows of targets with block_uid and block_type of the block that their label or block id names, null if none; a label goes before an id.

    Blocks of a page that share a label: the first one in order stands for it.
    """
    names = blocks.select(id_col, F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("label").alias("name")), F.struct(F.lit(1).alias("way"), F.col("block_uid").alias("name")))).alias("n"), "place", "block_uid", "block_type")
    first = names.where("n.name is not null").groupBy(id_col, F.col("n.name").alias("papyra_name")).agg(F.min_by(F.struct("block_uid", "block_type"), F.struct("n.way", "place")).alias("papyra_found"))
    asked = targets.withColumn("papyra_name", F.regexp_replace(target, "^#", ""))
    return asked.join(first, [id_col, "papyra_name"], "left").select(*targets.columns, F.col("papyra_found.block_uid").alias("block_uid"), F.col("papyra_found.block_type").alias("block_type"))
