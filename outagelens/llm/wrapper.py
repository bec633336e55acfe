"""Main text of web pages by wrappers inferred from pages of the same host.

A wrapper is a union-free regular expression over the token stream of a page,
nested by element: the children of an element are a sequence of items, each
plain, optional ``?`` or repeated ``+``, with text slots at the leaves. Pages
of a host are aligned one after another: a child that the other side lacks
becomes optional, neighbours of one kind become a repeated item, and children
that come in different orders become one repeated group of optional items. An
element holds each kind of child once, so a wrapper is bounded by the templates
of its host and not by the pages. Pages of a host are told apart by template
(an article or main element, else the layout elements at the top), each with a
wrapper of its own. Tasks align their own pages, and the partial wrappers of a
template are aligned with each other. Slots tell where the data lie: the main
text is all that the lowest element around them holds, constant or not, unless
the page names its container itself.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .url_filter import host_and_path

# fixed values: element names by their role in a page
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var ruby rt rp".split())
SKIPPED = frozenset("head nav header footer aside form button select option dialog menu object audio video canvas map datalist "
                    "fieldset input".split()) | frozenset(RAW)
MAIN = frozenset(("article", "main"))
CLOSES = {  # an open element that a start tag ends
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = frozenset("ul ol table dl article section div main body html aside nav form blockquote header footer td th".split())
# fixed values: words of class, id and role that mark boilerplate
BOILERPLATE = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|advertising|adsense|banners?|sponsor(?:ed|s)?|promos?|promoted|promotions?|cookies?|consent|gdpr|"
    r"notices?|alerts?|side-?bars?|menus?|nav(?:bar|igation)?|breadcrumbs?|foot(?:er)?|head(?:er)|masthead|comments?|commentlist|respond|"
    r"repl(?:y|ies)|discussion|disqus|related|recommend(?:ed|ations?)?|shar(?:e|ing)|social|newsletters?|subscri(?:be|ption)|sign-?up|"
    r"pop-?ups?|modals?|overlays?|widgets?|toolbars?|paginat(?:ion|or)|pager|contentinfo|complementary|search|dialog|skip-link)(?:$|[^a-z])")

# fixed values: classes of articles that hold a reader comment
READER = re.compile(r"(?:^|[.#\s])(?:comments?|repl(?:y|ies)|comment-(?:body|item|content))(?:$|\s)")

_TAG = re.compile(r"<[a-zA-Z/](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")
CONSTANT_PAGES = 10  # pages after which a text that never varies tells nothing about where the data of a template lie
LAYOUT = frozenset("div section table tbody tr td center".split())  # elements that tell templates apart
LAYOUT_DEPTH = 3
SHOWN = 64  # longer texts stand in a wrapper by their hash


class Element:
    """kind: the name with class, id and role; items: texts and elements in page order."""

    __slots__ = ("kind", "name", "items", "skip", "block")

    def __init__(self, kind: str, name: str, skip: bool, block: bool):
        self.kind, self.name, self.skip, self.block, self.items = kind, name, skip, block, []


def _element(tag: str, name: str) -> Element:
    if " " not in tag and "\n" not in tag and "\t" not in tag:
        return Element(name, name, name in SKIPPED, name not in INLINE)
    marks, hidden = [], False
    for key, *values in _ATTRIBUTE.findall(tag):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key in ("class", "id", "role") and value:
            marks.append(("." if key == "class" else "#" if key == "id" else "@") + _DIGITS.sub("0", " ".join(value.split())))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    skip = name in SKIPPED or hidden or any(
        READER.search(m) if name == "article" else BOILERPLATE.search(m) and name not in ("html", "body", *MAIN) for m in marks)
    return Element(name + "".join(marks), name, skip, name not in INLINE)


def _tokens(page: str) -> Iterator[str]:
    """Texts and tags of a page in time linear in its length. Comments, declarations and raw elements go.

    Quotes after ``=`` protect ``>``. Once a tag does not end before the page
    does, a ``>`` ends the tag whatever the quotes, here and in the rest.
    """
    at, end, last, quotes = 0, len(page), page.rfind(">"), True
    while at < end:
        low = page.find("<", at)
        if low < 0 or low > last and not page.startswith("<!--", low):
            yield page[at:]
            return
        if low > at:
            yield page[at:low]
        if page.startswith("<!--", low):
            at = page.find("-->", low + 4)
            if at < 0:
                return
            at += 3
            continue
        after = page[low + 1]
        if after in "!?":
            at = page.find(">", low) + 1
            continue
        if not (after == "/" or after.isascii() and after.isalpha()):
            yield "<"
            at = low + 1
            continue
        m = _TAG.match(page, low) if quotes else None
        quotes = m is not None
        at = m.end() if m else page.find(">", low) + 1
        tag = page[low:at]
        name = _NAME.match(tag)
        raw = _RAW_END.get(name[1].lower()) if name and after != "/" else None
        if raw is None or tag.endswith("/>") and name[1].lower() in ("svg", "math"):
            yield tag
            continue
        close = raw.search(page, at)
        if not close:
            return
        at = page.find(">", close.end()) + 1 or end


def parse(page: str) -> Element:
    """The element tree of a page. Comments and raw elements (scripts, styles) go; open ends are closed as browsers do."""
    root = Element("#", "#", False, True)
    stack = [root]
    count: dict[str, int] = {}  # open elements by name

    def close(k: int) -> None:
        for node in stack[k:]:
            count[node.name] -= 1
        del stack[k:]

    for token in _tokens(page):
        if token[0] != "<" or len(token) == 1 or token[-1] != ">":
            stack[-1].items.append(token)
            continue
        got = _NAME.match(token)
        if not got:
            continue
        name = got[1].lower()
        if token[1] == "/":
            if count.get(name):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if name == "br":
            stack[-1].items.append(" ")
        if name in VOID:
            continue
        node = _element(token, name)
        if node.block:
            ended = ("p", *CLOSES.get(name, ()))
            if any(count.get(x) for x in ended):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ended:
                        close(k)
                        break
                    if stack[k].name in SCOPES:
                        break
        elif node.kind == name and not node.skip:
            continue  # a plain inline element is part of the text around it
        stack[-1].items.append(node)
        if not token.endswith("/>"):
            stack.append(node)
            count[name] = count.get(name, 0) + 1
    return root


def template(root: Element) -> str:
    """Name of a page's template: ``article`` or ``main`` if it has such an element, else the layout elements at its top."""
    names, paths, todo = set(), set(), [(root, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        for x in node.items:
            if isinstance(x, str) or x.skip:
                continue
            for name in MAIN:
                if is_main(x, name):
                    names.add(name)
            if x.name in LAYOUT and 0 <= depth < LAYOUT_DEPTH:
                own = f"{path}/{x.kind}"
                paths.add(own)
                todo.append((x, own, depth + 1))
            else:  # what lies in other elements does not tell templates apart, but may be the container
                todo.append((x, path, depth if x.name in ("html", "body") else -1))
    return min(names) if names else hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def is_main(node: Element, name: str) -> bool:
    return node.name == name or f"@{name}" in node.kind


# ---------------------------------------------------------------- wrappers

def _item(kind: str, name: str, skip: bool) -> dict:
    """n: times seen (in how many parents), opt, rep: quantifiers, grp: children are a repeated group,
    text: None, a constant or True for a slot, mass: characters of its own text."""
    return {"k": kind, "t": name, "s": skip, "n": 1, "opt": False, "rep": False, "grp": False, "text": None, "mass": 0, "kids": []}


def _short(text: str) -> str:
    return text if len(text) <= SHOWN else "\0" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:24]


def _bare(node: Element) -> dict:
    """The wrapper of an element without its children."""
    out = _item(node.kind, node.name, node.skip)
    if not node.skip:
        own = " ".join(" ".join(x for x in node.items if isinstance(x, str)).split())
        out["text"], out["mass"] = _short(own) or None, len(own)
    return out


def generalise(node: Element) -> dict:
    """The wrapper of one page: neighbours of one kind become a repeated item, whose text is that of all."""
    top = _bare(node)
    frames = [(top, iter(() if node.skip else node.items), {})]
    while frames:
        out, items, at = frames[-1]
        for child in items:
            if isinstance(child, str):
                continue
            frames.append((_bare(child), iter(() if child.skip else child.items), {}))
            break
        else:
            frames.pop()
            if not frames:
                break
            parent, _, at = frames[-1]
            known = at.get(out["k"])
            if known is None:
                at[out["k"]] = len(at)
                parent["kids"].append(out)
                continue
            if known != len(at) - 1:
                parent["grp"] = True  # not neighbours: the span between them is a repeated group
            align(parent["kids"][known], out, one_page=True)
            parent["kids"][known]["rep"] = True
    return top


def align(one: dict, two: dict, one_page: bool = False) -> dict:
    """Make ``one`` match whatever either wrapper matches. Texts of two pages that differ make a slot; those of
    one page follow each other."""
    todo = [(one, two)]
    while todo:
        a, b = todo.pop()
        if one_page:
            if b["text"] is not None:
                a["text"] = b["text"] if a["text"] is None else _short(f"{a['text']}\n{b['text']}")
        else:
            if a["text"] != b["text"] and b["text"] is not None:
                a["text"] = b["text"] if a["text"] is None else True
            a["n"] += b["n"]
        a["mass"] += b["mass"]
        for flag in ("opt", "rep", "grp"):
            a[flag] |= b[flag]
        kids = a["kids"]
        place = {kid["k"]: i for i, kid in enumerate(kids)}
        seen, last = set(), -1
        fresh: dict[int, list[dict]] = {}
        for kid in b["kids"]:
            i = place.get(kid["k"])
            if i is None:
                kid["opt"] = True
                fresh.setdefault(last, []).append(kid)
                continue
            if i < last:
                a["grp"] = True  # another order
            todo.append((kids[i], kid))
            seen.add(i)
            last = max(last, i)
        merged = fresh.get(-1, [])
        for i, kid in enumerate(kids):
            if i not in seen:
                kid["opt"] = True
            merged.append(kid)
            merged += fresh.get(i, [])
        a["kids"] = merged
    return one


def expression(item: dict) -> str:
    """The wrapper as a regular expression, for reading."""
    out, todo = [], [item]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        many = "*" if x["opt"] and x["rep"] else "?" if x["opt"] else "+" if x["rep"] else ""
        own = [] if x["text"] is None else ["#TEXT" if x["text"] is True or x["rep"] else x["text"]]
        inner: list = []
        for part in [*own, *x["kids"]]:
            inner += [" ", part] if inner else [part]
        group = ("(", ")+") if x["grp"] else ("", "")
        todo += reversed([f"(<{x['k']}>{group[0]}", *inner, f"{group[1]}</{x['t']}>){many}"])
    return "".join(out)


_FIELDS = ("k", "t", "s", "n", "opt", "rep", "grp", "text", "mass")


def pack(wrapper: dict) -> str:
    """A wrapper as JSON: its items in page order, each with the place of its parent (nesting may be deeper than JSON's)."""
    rows, todo = [], [(wrapper, -1)]
    while todo:
        item, parent = todo.pop()
        todo += [(kid, len(rows)) for kid in reversed(item["kids"])]
        rows.append([parent, *(item[f] for f in _FIELDS)])
    return json.dumps(rows)


def unpack(text: str) -> dict:
    items: list[dict] = []
    for parent, *values in json.loads(text):
        item = dict(zip(_FIELDS, values), kids=[])
        if parent >= 0:
            items[parent]["kids"].append(item)
        items.append(item)
    return items[0]


def infer_wrappers(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """(host, template, wrapper as packed JSON): all pages of a host and template aligned, in tasks first and then
    over them in two steps."""
    schema = "host string, template string, wrapper string"

    def table(held: dict[tuple[str, str], dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), pa.array([t for _, t in held], pa.string()),
                                           pa.array(map(pack, held.values()), pa.string())], names=["host", "template", "wrapper"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = parse(page)
                key, got = (host, template(tree)), generalise(tree)
                held[key] = align(held[key], got) if key in held else got
                if len(held) > 2000:
                    yield table(held)
                    held = {}
        if held:
            yield table(held)

    def merge(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in group:
            key = batch.column("host")[0].as_py(), batch.column("template")[0].as_py()
            for text in batch.column("wrapper").to_pylist():
                held = unpack(text) if held is None else align(held, unpack(text))
        yield table({key: held})

    parts = pages.select(host_col, html_col).mapInArrow(own, schema)
    parts = parts.withColumn("salt", F.spark_partition_id() % 64)
    for keys in (["host", "template", "salt"], ["host", "template"]):
        parts = parts.groupBy(*keys).applyInArrow(merge, schema)
        if "salt" in keys:
            parts = parts.withColumn("salt", F.lit(0))
    return parts.select("host", "template", "wrapper")


# ---------------------------------------------------------------- extraction

def content_plan(wrapper: dict) -> tuple[int, frozenset]:
    """(path of the container, paths of headings that vary) of a template, paths as hashes of this process.

    The container is the lowest element around the parents of all slots. A text
    is a slot if it varies over the pages, or while fewer than ``CONSTANT_PAGES``
    have it; without any slot all texts are.
    """
    rows: list[tuple[dict, int, int]] = []  # item, path, place of its parent; parents first
    todo = [(wrapper, 0, -1)]
    while todo:
        item, path, parent = todo.pop()
        todo += [(kid, hash((path, kid["k"])), len(rows)) for kid in item["kids"] if not kid["s"]]
        rows.append((item, path, parent))
    titles = frozenset(path for item, path, _ in rows if item["t"] == "h1" and item["text"] is True)
    slots = [i for i, (item, _, _) in enumerate(rows) if item["text"] is True or item["text"] is not None and item["n"] < CONSTANT_PAGES]
    slots = slots or [i for i, (item, _, _) in enumerate(rows) if item["text"] is not None]
    below, here = [0] * len(rows), [0] * len(rows)
    for i in slots:
        here[max(rows[i][2], 0)] += 1
    for i in range(len(rows) - 1, -1, -1):
        below[i] += here[i]
        if rows[i][2] >= 0:
            below[rows[i][2]] += below[i]
    # elements around all slots form a chain from the root; the last of them is the container
    around = [i for i in range(len(rows)) if below[i] == len(slots)] if slots else [0]
    return rows[around[-1]][1], titles


def containers(root: Element, plan: tuple[int, frozenset]) -> set[int]:
    """Places (``id``) of the elements of a page that hold its main text.

    Its outermost article elements, else main elements, else the container of
    its template, else that of the page alone. A heading h1 elsewhere belongs to
    the text if it varies over the pages or the containers have none.
    """
    found: dict[str, list[int]] = {"article": [], "main": [], "plan": []}
    titles: list[tuple[int, int, frozenset]] = []  # h1: place, path, kinds of containers around it
    todo: list[tuple[Element, int, frozenset]] = [(root, 0, frozenset())]
    while todo:
        node, path, around = todo.pop()
        kinds = [name for name in MAIN if is_main(node, name)] + (["plan"] if path == plan[0] else [])
        for kind in kinds:
            if kind not in around:
                found[kind].append(id(node))
                around = around | {kind}
        if node.name == "h1":
            titles.append((id(node), path, around))
        todo += [(x, hash((path, x.kind)), around) for x in node.items if not isinstance(x, str) and not x.skip]
    chosen = next((k for k in ("article", "main", "plan") if found[k]), None)
    if chosen is None:
        return containers(root, content_plan(generalise(root)))
    bare = not any(chosen in around for _, _, around in titles)
    return set(found[chosen]) | {at for at, path, around in titles if chosen not in around and (bare or path in plan[1])}


def extract(root: Element, plan: tuple[int, frozenset]) -> str:
    """Main text: the blocks of the containers in page order, white space made single, one line each."""
    tops = containers(root, plan)
    blocks: list[str] = []
    text: list[str] = []

    def flush() -> None:
        got = " ".join(entities.unescape("".join(text)).split())
        if got:
            blocks.append(got)
        text.clear()

    frames = [(root, iter(root.items), id(root) in tops)]
    while frames:
        node, items, inside = frames[-1]
        for x in items:
            if isinstance(x, str):
                if inside:
                    text.append(x)
            elif not x.skip:
                if x.block:
                    flush()
                frames.append((x, iter(x.items), inside or id(x) in tops))
                break
        else:
            frames.pop()
            if node.block:
                flush()
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (page_id, url, text), the main text by the wrapper of the page's host and template.

    Null and empty pages give an empty text, null urls and those without
    ``://`` share the empty host; null ids are carried along; repeated rows
    are aligned and extracted each; other columns do not matter; an empty table
    gives an empty result. Very long pages, deep nesting and open quotes are read
    whole, in time and memory linear in the page. Ties: of elements that
    lie around the same slots the innermost is the container.
    """
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    wrappers = stored(infer_wrappers(rows), "wrappers")
    kind = dict(rows.dtypes)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array((template(parse(page)) for page in batch.column("html").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*batch.schema.names, "template"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[tuple[str, str], tuple] = {}
        for batch in batches:
            texts = []
            for host, name, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "html", "wrapper"))):
                if (host, name) not in plans:
                    if len(plans) > 5000:
                        plans.clear()
                    plans[host, name] = content_plan(unpack(wrapper))
                texts.append(extract(parse(page), plans[host, name]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    of_page = rows.mapInArrow(named, f"page_id {kind['page_id']}, url {kind['url']}, host string, html string, template string")
    return of_page.join(wrappers, ["host", "template"]).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")
