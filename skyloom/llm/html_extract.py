"""Main text of HTML pages by paths on which a host's pages agree.

Every page scores its containers and votes for the tag-class path of the best one; votes are
summed per host in Spark; each page is then extracted from the container on its host's leading
path that it has. A tag-class path is generalised: ids are left out and digits become ``#``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import md5

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import carried, column, schema_of
from skyloom.llm.url_filters import host_of
from skyloom.storage import stage

#: Paths kept per host, best first: a page without the first takes the next that it has, and one
#: that has none of them its own best container.
PATHS = 100
#: Elements that may be open at once; a deeper one's tags are passed over, its text is kept.
DEPTH = 1_000
#: A longer path is stated by its digest, so that unclosed elements don't make paths without end.
PATH_CHARS = 2_000
#: Share of a container's text that makes a container in it stand for it.
NEARLY_ALL = 0.95

#: Elements whose content is not markup; all of it is dropped.
RAW = frozenset("script style noscript template textarea select iframe svg object title".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: Up to the end of a tag; a quote counts after an equals sign only.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTRIBUTE = re.compile(r"(?<![a-z-])([a-z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>|</{tag}\Z", re.I) for tag in RAW}


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) in page order: ``text``, ``start`` and ``end`` of elements by name in
    lower case. Comments, declarations and raw elements are passed over; a ``<`` that begins no tag,
    or a tag that never ends, is text. Each character is looked at a few times only."""
    at, text, last = 0, 0, page.rfind(">")
    while True:
        at = page.find("<", at)
        comment = at >= 0 and page.startswith("<!--", at)
        if at < 0 or at > last and not comment:
            break
        nxt = page[at + 1 : at + 2]
        ends = nxt == "/"
        name = NAME.match(page, at + 1 + ends)
        if name:
            rest = REST.match(page, name.end())
            stop = rest.end() if rest else page.find(">", name.end()) + 1
        elif comment:
            stop = page.find("-->", at + 4) + 3
            stop = stop if stop > 2 else len(page)
        elif nxt in ("!", "?", "/"):
            stop = page.find(">", at) + 1
        else:
            at += 1
            continue
        if at > text:
            yield "text", page[text:at], ""
        if name:
            tag, attrs = name[0].lower(), page[name.end() : stop - 1]
            if not ends and tag in RAW:
                if not (tag == "svg" and attrs.endswith("/")):
                    close = RAW_END[tag].search(page, stop)
                    stop = close.end() if close else len(page)
            else:
                yield "end" if ends else "start", tag, attrs
        at = text = stop
    if text < len(page):
        yield "text", page[text:], ""


# The element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td".split())
FIELDS = frozenset("button input select textarea".split())
SENTENCE = re.compile(r"[.!?](?=\s|\Z)")
PARAGRAPHS = frozenset("p h1 h2 h3 blockquote pre li td".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
LEFT_OUT = frozenset("aside button dialog footer head header menu nav".split())
#: Words that say what an element is when they are a class or id, alone or beside ``PLAIN`` words.
LEFT_OUT_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo promoted recommended related reply replies respond share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split()
)
#: Words of position and form: ``share-buttons`` is a share, ``market-share`` is not.
PLAIN = frozenset(
    "area aside bar block body bottom box btn button buttons card cards center col column container content desktop "
    "float form global group head heading icon icons inline inner item items label large left link links list main "
    "message mobile module outer page panel post posts articles stories primary right row secondary section site "
    "slot small sticky strip text this title top unit us widget wrap wrapper zone".split()
)
#: Of the words, those that an article may use as well: in one they count with a second sign only.
WEAK_WORDS = frozenset("banner discussion header menu notice promo promoted recommended related reply respond share sharing social widget".split())
#: Of these words, those that name what readers wrote: it may be longer than the article.
TALK_WORDS = frozenset("comment comments discussion disqus replies reply respond".split())
#: Names such as with-sidebar or has-banner say what stands beside the element.
BESIDE = re.compile(r"(?<![a-z0-9])(?:with|without|has|no|not)[-_]+[a-z0-9]+")
LEFT_OUT_ROLES = frozenset("alert banner complementary contentinfo dialog menu navigation search".split())


#: An element left out by form or by a word of its names, unless it holds most of the page's text;
#: by a weak word, in an article, it needs a second sign as well.
DOUBT, TALK, WEAK = 1, 2, 3
#: Characters and sentences below which a text is no part of an article's argument.
FEW_CHARS, FEW_SENTENCES = 200, 3


class Node:
    """An element. ``out`` is left out, ``doubt`` may be (DOUBT, TALK, WEAK). ``paragraphs`` is all
    paragraph text in it that is kept, however deep, ``within`` the part of it that lies in
    containers inside, ``inner`` the first of most text, ``fields`` the form fields in it."""

    __slots__ = ("tag", "path", "out", "doubt", "parent", "own", "chars", "linked", "paragraphs", "within", "inner", "start", "stop", "fields")

    def __init__(self, tag, path, out, doubt, parent, start):
        self.tag, self.path, self.out, self.doubt, self.parent, self.start = tag, path, out, doubt, parent, start
        self.own, self.fields = (0, 0), 0
        self.stop = None


def parse(page: str) -> tuple[list, list[Node]]:
    """Pieces of text as (text, block number, element), and the kept containers with the range of
    their pieces. Comments, scripts and other raw elements are dropped here."""
    root = Node("", "", False, None, None, 0)
    stack, pieces, nodes, block = [root], [], [root], 0
    opened: dict[str, int] = {}

    def add(raw: str) -> None:
        text = " ".join(entities.unescape(raw).split()) if "&" in raw else " ".join(raw.split())
        if raw:
            top = stack[-1]
            linked = any(n.tag == "a" for n in stack[-3:])
            pieces.append((raw, block, top))
            if text:
                top.own = (top.own[0] + len(text), top.own[1] + len(text) * linked)

    def close(index: int) -> None:
        for n in stack[index:]:
            n.stop = len(pieces)
            opened[n.tag] -= 1
        del stack[index:]

    for kind, tag, attrs in markup(page):
        if kind == "text":
            add(tag)
            continue
        if tag in BLOCK:
            block += 1
        if kind == "end":
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # a stray inline end tag doesn't close blocks
            continue
        if tag in FIELDS:
            stack[-1].fields += 1
        if tag in VOID:
            continue
        if tag in BLOCK and opened.get("p"):  # an open paragraph ends where a block begins
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSED_BY and any(opened.get(t) for t in CLOSED_BY[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSED_BY[tag]:
                    close(i)
                    break
                if stack[i].tag in SCOPE[tag]:
                    break
        if len(stack) > DEPTH:
            continue
        names, left_out, doubt = "", tag in LEFT_OUT, DOUBT if tag == "form" else None
        parent = stack[-1]
        if tag == "header" and (opened.get("article") or opened.get("main")):
            left_out = False
        if attrs.strip(" /\n\t"):
            values = _values(attrs)
            left_out = left_out or _hidden(values)
            doubt = doubt or _doubt(values, bool(opened.get("article") or opened.get("main")))
            names = _classes(values)
        if tag in ("html", "body"):
            left_out, doubt = False, None
        if tag in ("h1", "main"):
            for n in stack:
                n.doubt = n.doubt and DOUBT  # talk has no title of the page in it
        path = f"{parent.path}/{tag}{names}"
        if len(path) > PATH_CHARS:
            path = md5(path.encode("utf-8", "surrogatepass")).hexdigest()
        node = Node(tag, path, parent.out or left_out, doubt, parent, len(pieces))
        stack.append(node)
        nodes.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    close(1)
    root.stop = len(pieces)
    _settle(nodes, pieces)
    return pieces, [n for n in nodes if n.tag in CONTAINER and not n.out] or [root]


def _sum(nodes: list[Node]) -> None:
    """Sums of what is kept in each element; ``nodes`` in the order in which they open."""
    for n in nodes:
        n.chars, n.linked = n.own
        n.paragraphs = n.within = 0
        n.inner = None
    for n in reversed(nodes):
        if n.tag in PARAGRAPHS and n.chars > n.linked:
            n.paragraphs = n.chars - n.linked
        up = n.parent
        if up is None or n.out:
            continue
        up.chars += n.chars
        up.linked += n.linked
        up.fields += n.fields
        up.paragraphs += n.paragraphs
        inner = n if n.tag in CONTAINER else n.inner
        up.within += n.paragraphs if inner is n else n.within
        if inner is not None and (up.inner is None or mass(inner) >= mass(up.inner)):
            up.inner = inner


def _signed(n: Node, pieces: list) -> bool:
    """A second sign that the element is no part of the article: fields, links, little text, or that
    nothing of the element around it follows."""
    if n.fields or n.chars < FEW_CHARS or 2 * n.linked > n.chars:
        return True
    if n.parent.tag in ("article", "main") and all(at.out or not raw.strip() for raw, _, at in pieces[n.stop : n.parent.stop]):
        return True
    return sum(len(SENTENCE.findall(raw)) for raw, _, _ in pieces[n.start : n.stop]) < FEW_SENTENCES


def _settle(nodes: list[Node], pieces: list) -> None:
    """Leaves the elements in doubt out: talk, unless the page has no other text; then others that
    don't hold most of the text that is left."""
    _sum(nodes)
    for doubts, share in (((TALK,), 1.0), ((DOUBT, WEAK), 0.5)):
        if any(n.doubt in doubts and not n.out for n in nodes):
            least = share * mass(nodes[0])
            for n in nodes[1:]:
                n.out = n.out or n.parent.out
                if n.doubt not in doubts or n.out:
                    continue
                holds = mass(n) >= least if n.doubt == TALK else mass(n) > least
                n.out = not holds and (n.doubt != WEAK or _signed(n, pieces))
            _sum(nodes)


def _values(attrs: str) -> dict[str, str]:
    return {(a or h).lower(): x or y or z for a, x, y, z, h in ATTRIBUTE.findall(attrs)}


def _hidden(v: dict[str, str]) -> bool:
    return (
        "hidden" in v
        or v.get("aria-hidden", "").lower() == "true"
        or v.get("role", "").lower() in LEFT_OUT_ROLES
        or bool(re.search(r"display\s*:\s*none", v.get("style", ""), re.I))
    )


def _doubt(v: dict[str, str], inside: bool) -> int | None:
    """What the names of an element say of it; ``inside`` an article or main a word may be its own."""
    found = set()
    for name in BESIDE.sub(" ", f"{v.get('class', '')} {v.get('id', '')}".lower()).split():
        parts = {re.sub(r"\d+$", "", part) for part in re.split(r"[^a-z0-9]+", name)} - {""}
        said = parts & LEFT_OUT_WORDS
        # Outside an article the word is enough; inside the rest of the name must say nothing else.
        if said and (not inside or parts - said <= PLAIN):
            found |= said
    if found & TALK_WORDS and (not inside or found & TALK_WORDS - WEAK_WORDS):
        return TALK
    if v.get("role", "").lower() == "form" or found - WEAK_WORDS or found and not inside:
        return DOUBT
    return WEAK if found else None


def _classes(v: dict[str, str]) -> str:
    names = sorted(set(re.sub(r"\d+", "#", v.get("class", "")).lower().split()))
    return "".join(f".{n}" for n in names)


def mass(node: Node) -> float:
    """Paragraph text that the container holds at any depth, less what is linked."""
    return node.paragraphs + 0.2 * (node.chars - node.linked)


def score(node: Node) -> float:
    """A section is a part, so that it doesn't win against what holds it and other text."""
    return {"article": 1.5, "main": 1.3, "body": 0.6, "section": 0.6, "": 0.5}.get(node.tag, 1.0) * mass(node)


def best_of(containers: list[Node]) -> Node:
    """The container of the highest score, or the lowest one in it that holds nearly all of its
    text. An article and a container with paragraphs of its own are not left for a part of them."""
    best = max(containers, key=lambda n: (score(n), -n.start, n.path))
    while best.tag != "article" and best.paragraphs == best.within:
        lower = best.inner
        if lower is None or lower.tag == "section" or mass(lower) < NEARLY_ALL * mass(best):
            break
        best = lower
    return best


def text_of(pieces: list, nodes: list[Node]) -> str:
    """The blocks of the containers, each with single spaces, joined by line breaks."""
    blocks: dict[int, list[str]] = {}
    for node in nodes:
        for raw, block, at in pieces[node.start : node.stop]:
            if not at.out:
                blocks.setdefault(block, []).append(raw)
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(page: str | None, paths: list[str] | None) -> str:
    """Text of all containers on the first of the paths that the page has, or else on the path of
    its own best container."""
    if not page:
        return ""
    pieces, containers = parse(page)
    by_path: dict[str, list[Node]] = {}
    for n in containers:
        by_path.setdefault(n.path, []).append(n)
    for path in paths if paths is not None else ():
        if path in by_path:
            return text_of(pieces, by_path[path])
    return text_of(pieces, by_path[best_of(containers).path])


def _vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        votes = []
        for host, page in zip(frame.host, frame.html, strict=True):
            if page:
                best = best_of(parse(page)[1])
                if best.chars:
                    votes.append((host, best.path))
        yield pd.DataFrame(votes, columns=["host", "path"], dtype=object)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [extract(page, paths) for page, paths in zip(column(batch, "html"), column(batch, "paths"), strict=True)]
        sizes = pa.array([len(t) for t in text], pa.int64())
        yield carried(batch, ["page_id", "url"], text=pa.array(text, pa.string()), n_chars=sizes)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the leading paths of each host, by votes and then by name."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(_vote, "host string, path string")
    ranked = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return (
        votes.groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("votes"))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= PATHS)
        .groupBy("host")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x.path).alias("paths"))
    )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    A null or empty html gives an empty text; a page without a container on its host's paths,
    or of an unknown host (null url: the empty host), is taken from its own best container.
    Repeated rows are extracted each; other columns are ignored; an empty table gives none.

    The table of host paths is stored first, so that Spark knows its true size when it chooses
    between a broadcast below its threshold and a shuffle of the pages, in which AQE splits a
    host that holds many of them.
    """
    pages = pages.select("page_id", "url", "html")
    winners = stage(host_paths(pages), "host-paths")
    return (
        pages.withColumn("host", host_of(F.col("url")))
        .join(winners, "host", "left")
        .mapInArrow(_extract, schema_of(pages.drop("html"), text="string", n_chars="long"))
    )
