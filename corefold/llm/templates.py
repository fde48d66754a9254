"""Main text of web pages by equivalence classes of template tokens.

Tokens are the elements of a page by their path (tag and first class of each
ancestor) and its text runs by path and content. Two tokens of a host with the same
occurrence vector, the number of occurrences on each of its pages, are in one class;
the vector is compared as a sum of hashes of (page, count), so a host's tokens are
aggregated, never gathered. A class is valid with SIZE tokens, on SUPPORT pages and
half of the host's. A text run of a valid class is template where it follows the
same element of its class on all pages, so that it has one place in the nest of
classes; inside the article's container what is left around it must also differ on
SUPPORT pages. Where template text would be half of the container's text or more on
half of a class's pages, the host shares an article and the class is none: its text
is kept. Elements of valid classes below elements of the template give the
container. The page's text is what stands in the container's slots, outside template
text, menus, forms, notices, adverts and comments. Hosts with fewer pages use the
page's own elements in place of a template.

Null or empty html gives an empty text; a null url is a host of its own. Repeated
rows are answered one by one.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.llm import common

SUPPORT = 3
SIZE = 3
BROADCAST_BYTES = 32 << 20

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are never part of an article.
FRAME = frozenset("head nav footer aside form script style title textarea iframe noscript button select template svg menu dialog object canvas audio video".split())
#: Words of class, id and role that mark such parts.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|modal|popup|overlay|newsletter|subscri\w+|sign-?up|login|nav\w*|menus?|"
    r"breadcrumbs?|side-?bar|sidebar|widgets?|related|recommend\w*|shar(?:e|ing)|social|comments?|repl(?:y|ies)|respond|discussion|footer|masthead|toolbar|pager|pagination|copyright|"
    r"disclaimer|skip-?link)(?:$|[\s_-])", re.I,
)
#: An open element of the first set is closed by the start of one of the second.
CLOSES = {
    "p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"}, "head": {"body"},
}
#: An end tag does not reach beyond these.
WALLS = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "p": {"article", "section", "div", "td", "li", "body"}}
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_DIGITS = re.compile(r"[0-9]+")


@dataclass
class Element:
    tag: str
    path: str
    frame: bool  # menus and the like, by tag or marks
    container: int  # rank as the article's container; 0: none
    holders: tuple[str, ...] = field(default=())  # paths from the root to here


@dataclass
class Run:
    """A piece of text, or a block border where text is None."""

    text: str | None
    inside: tuple[Element, ...]
    before: int  # elements begun before it


def parse(html: str | None) -> tuple[list[Element], list[Run]]:
    """Elements in order and text runs with their open elements."""
    html = html or ""
    elements: list[Element] = []
    runs: list[Run] = []
    stack: list[Element] = []
    inside: tuple[Element, ...] = ()
    at, size, quoted = 0, len(html), True
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        if start > at:
            runs.append(Run(html[at:start], inside, len(elements)))
        if start == size:
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(html, start)
        if name is None:
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            else:
                runs.append(Run("<", inside, len(elements)))
                at = start + 1
            continue
        rest = _REST.match(html, name.end()) if quoted else None
        if rest is None:
            quoted = False  # an open quote: from here on tags end at the next bracket
            end = html.find(">", name.end())
            end = size if end < 0 else end + 1
        else:
            end = rest.end()
        tag, at = name[1].lower(), end
        if tag in BLOCK:
            runs.append(Run(None, inside, len(elements)))
        if html[start + 1] == "/":
            walls = WALLS.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in walls:
                    break
            inside = tuple(stack)
            continue
        while stack and tag in CLOSES.get(stack[-1].tag, ()):
            stack.pop()
        if tag in BLOCK and tag != "br":  # a paragraph below open inline elements ends as well
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        marks = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(html[name.end() : end - 1])}
        first = _DIGITS.sub("", (marks.get("class", "").split() or [""])[0]).lower()
        path = f"{stack[-1].path if stack else ''}/{tag}{'.' + first if first else ''}"
        frame = tag in FRAME or bool(MARKS.search(" ".join(marks.values()))) or marks.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search")
        frame = frame and tag not in ("html", "body")
        rank = 3 if tag == "article" else 2 if tag == "main" or marks.get("role", "").lower() == "main" else 1 if re.search(r"(?:^|[\s_-])(?:content|post|entry|story|article)(?:$|[\s_-])", " ".join(marks.values()), re.I) else 0
        frame = frame or tag == "header" and not any(e.container == 3 for e in stack)
        element = Element(tag, path, frame, 0 if frame else rank)
        elements.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(html, at)
            at = size if close is None else close.start()
        stack.append(element)
        inside = tuple(stack)
    return elements, runs


def _hash(text: str) -> int:
    """63 bits, not negative."""
    data = text.encode("utf-8", "replace")
    return zlib.crc32(data) << 31 ^ zlib.adler32(data)


def _inner(run: Run) -> bool:
    return any(e.container for e in run.inside)


def _run_mark(run: Run) -> int:
    """Hash of a text run and its place."""
    return _hash(f"{run.inside[-1].path if run.inside else ''}\n{_inner(run)}\n{' '.join(run.text.split())}")


def _own(elements: list[Element], container: str | None) -> set[str]:
    """Paths of the page's containers: the template's and what is of its kind, or
    else the page's own of the highest rank."""
    ranks = [e.container for e in elements if e.container and e.path == container] or [e.container for e in elements]
    rank = max(ranks, default=0)
    return {e.path for e in elements if rank and e.container == rank}


def _shown(inside: tuple[Element, ...], own: set[str]) -> bool:
    """Whether tags and marks leave a run to the page's text."""
    if not own:
        return not any(e.frame for e in inside)
    first = next((i for i, e in enumerate(inside) if e.container and e.path in own), None)
    return not (first is None or any(e.frame for e in inside[:first] if e.tag in FRAME) or any(e.frame for e in inside[first:]))


def tokens_of(html: str | None) -> dict[tuple[str, int, int], int]:
    """(path, rank as container, text mark or -1) -> occurrences on the page. Text
    inside a container has the rank -1."""
    elements, runs = parse(html)
    out: dict[tuple[str, int, int], int] = {}
    for e in elements:
        key = (e.path, e.container, -1)
        out[key] = out.get(key, 0) + 1
    for r in runs:
        if r.text and not any(e.frame and e.tag in FRAME for e in r.inside) and r.text.strip():
            key = (r.inside[-1].path if r.inside else "", -1 if _inner(r) else 0, _run_mark(r))
            out[key] = out.get(key, 0) + 1
    return out


def places_of(html: str | None, container: str | None, texts: dict[int, str], paths: dict[str, str]) -> tuple[list[tuple[int, int, bool]], int, bool]:
    """(mark, hash of the element of its class that it follows, inside a container)
    of each given text at its first place, the hash of the other text of the page's
    containers, and whether the given texts are half of theirs or more. ``texts`` and
    ``paths`` lead to classes."""
    elements, runs = parse(html)
    own = _own(elements, container)
    out: dict[int, tuple[int, int, bool]] = {}
    last: dict[str, str] = {}
    rest, taken, at = [], 0, 0
    for r in runs:
        text = " ".join(r.text.split()) if r.text else ""
        if not text:
            continue
        for e in elements[at : r.before]:
            if e.path in paths:
                last[paths[e.path]] = e.path
        at = max(at, r.before)
        mark, shown = _run_mark(r), bool(own) and _shown(r.inside, own)
        if mark in texts:
            if mark not in out:
                out[mark] = (mark, _hash(last.get(texts[mark], "")), _inner(r))
            taken += len(text) * shown
        elif shown:
            rest.append(text)
    return list(out.values()), _hash("\n".join(rest)), taken > 0 and taken >= sum(map(len, rest))


def main_text(html: str | None, container: str | None, frame_marks: frozenset[int]) -> str:
    """What the slots of the container hold; without one, all of the page but its frame."""
    elements, runs = parse(html)
    own = _own(elements, container)
    parts: list[str] = []
    for run in runs:
        if run.text is None:
            parts.append(" ")
        elif _shown(run.inside, own) and not (frame_marks and run.text.strip() and _run_mark(run) in frame_marks):
            parts.append(entities.unescape(run.text))
    return " ".join("".join(parts).split())


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit("")))


def host_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, container, marks: the valid classes of each host, nested by path and place."""
    rows = pages.select(host_of(url).alias("host"), F.xxhash64(*pages.columns).alias("page"), F.col(html).alias("html"))

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("host", "page", "path", "rank", "mark", "n")}
        for host, page, text in zip(b["host"], b["page"], b["html"]):
            for (path, rank, mark), n in tokens_of(text).items():
                for c, v in zip(out, (host, page, path, rank, mark, n)):
                    out[c].append(v)
        return out

    tokens = common.scan(rows, run, "host string, page bigint, path string, rank int, mark bigint, n int")
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= SUPPORT)
    vectors = tokens.groupBy("host", "path", "rank", "mark").agg(F.count("*").alias("on"), F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector"))
    # Written: the steps below read it several times, the pages are parsed once.
    valid = common.written(vectors.filter(F.col("on") >= SUPPORT).join(sizes, "host").filter(F.col("on") * 2 >= F.col("pages")), "page-classes")
    classes = valid.groupBy("host", "vector", "on").agg(F.count("*").alias("size")).filter(F.col("size") >= SIZE)
    valid = valid.join(classes, ["host", "vector", "on"])
    # A class of its own counts only where its token's parent is in the template.
    elements = valid.filter("mark = -1")
    parents = elements.select("host", F.col("path").alias("parent")).distinct()
    nested = elements.withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    nested = nested.join(parents, ["host", "parent"], "left_semi").unionByName(nested.filter("parent = ''"))
    best = F.max(F.when(F.col("rank") > 0, F.struct("rank", (-F.length("path")).alias("near"), "on", "path")))
    containers = nested.groupBy("host").agg(best["path"].alias("container"))
    return containers.join(_template_texts(rows, valid, containers), "host", "full").withColumn("marks", F.coalesce("marks", F.expr("cast(array() AS array<bigint>)")))


def _template_texts(rows: DataFrame, valid: DataFrame, containers: DataFrame) -> DataFrame:
    """host, marks: the text runs of valid classes that have one place in the host's
    template. Only pages of hosts with such classes are read again."""
    texts = valid.filter("mark >= 0").groupBy("host").agg(F.collect_list(F.struct("mark", "vector")).alias("texts"))
    held = valid.filter("mark >= 0").select("host", "vector").distinct()
    paths = valid.filter("mark = -1").join(held, ["host", "vector"], "left_semi").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "vector"))).alias("paths"))
    hosts = common.written(texts.join(paths, "host", "left").join(containers, "host", "left"), "page-texts")
    bytes_ = hosts.agg(F.sum(F.length("host") + 32 * F.size("texts") + F.coalesce(F.expr("aggregate(paths, 0, (n, p) -> n + length(p.path) + 32)"), F.lit(0)))).first()[0] or 0
    pages = rows.join(F.broadcast(hosts) if bytes_ <= BROADCAST_BYTES else hosts, "host")

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("host", "vector", "mark", "place", "inner", "others", "full")}
        for host, html, container, own, above in zip(b["host"], b["html"], b["container"], b["texts"], b["paths"]):
            classes = {x["mark"]: str(x["vector"]) for x in own}
            got, others, full = places_of(html, container, classes, {x["path"]: str(x["vector"]) for x in above or ()})
            for mark, place, inner in got:
                for c, v in zip(out, (host, classes[mark], mark, place, inner, others, full)):
                    out[c].append(v)
        return out

    seen = common.scan(pages, run, "host string, vector string, mark bigint, place bigint, inner boolean, others bigint, full boolean")
    # First per text and content around it, then per text: a host's pages are counted on all tasks.
    some = seen.groupBy("host", "vector", "mark", "others").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.max("inner").alias("inner"), F.count("*").alias("n"), F.sum(F.col("full").cast("long")).alias("full"))
    each = some.groupBy("host", "vector", "mark").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("inner").alias("inner"), F.count("*").alias("differ"), F.sum("n").alias("n"), F.sum("full").alias("full"))
    keep = (F.col("low") == F.col("high")) & (~F.col("inner") | (F.col("differ") >= SUPPORT) & (F.col("full") * 2 < F.col("n")))
    return each.filter(keep).groupBy("host").agg(F.collect_set("mark").alias("marks"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text; one row per input row."""
    templates = common.written(host_templates(pages, url, html), "templates")
    bytes_ = templates.agg(F.sum(F.length(F.coalesce("container", F.lit(""))) + F.length("host") + 8 * F.size("marks"))).first()[0] or 0
    if bytes_ <= BROADCAST_BYTES:
        templates = F.broadcast(templates)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    rows = rows.join(templates, "host", "left").select("page_id", "url", "html", "container", "marks")

    def run(b: dict[str, list]) -> dict[str, list]:
        text = [main_text(h, c, frozenset(m or ())) for h, c, m in zip(b["html"], b["container"], b["marks"])]
        return {"page_id": b["page_id"], "url": b["url"], "text": text}

    kinds = dict(rows.dtypes)
    return common.scan(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
