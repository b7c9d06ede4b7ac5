"""The main text of web pages by minimum cuts.

A page is read into blocks of text and the tree of elements around them. A classifier gives
each block a score from its words, links and place: its cost of being called boilerplate
(positive) or content (negative), which become capacities to the two terminals. Neighbouring
blocks are joined by edges that weaken with their distance in the tree, and every block to
its section and sections to their parents, so that labels are smooth along the page and in
the tree. The minimum cut of this graph, by maximum flow, is the cheapest labelling.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import whole_text, worker_value

#: Comments and declarations, end tags, start tags; quotes only hold behind an equals sign.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|[^a-zA-Z][^>]*+(?:>|\Z))"""
    r"""|<([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and elements whose text is never shown as text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SILENT = frozenset("noscript template svg select button object audio video canvas datalist head map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
IN_HEAD = frozenset("meta link base title style script noscript template head html".split())
#: Elements that hold one block; the section of a block is the nearest other element.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd tr pre".split())
#: What the start of an element closes, if it is open innermost.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("td", "th", "tr", "thead"), "body": ("head",)}

APART_TAGS = frozenset("nav footer aside form dialog menu fieldset header".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status tooltip".split())
#: Words in classes and ids of what is not the article; those of the second list as beginnings.
APART_NAMES = frozenset("ad ads adv advt nav header footer foot bottom top aside menu social share sharing shares login signin signup alert alerts gdpr notice notices "
                        "notification meta tags tagcloud reply respond replies feedback pager skip legal toolbar search form popular trending latest byline".split())
APART_BEGINNINGS = ("advert", "sponsor", "promo", "sidebar", "comment", "cookie", "consent", "newsletter", "subscri", "navig", "navbar", "breadcrumb", "paginat",
                    "related", "recommend", "popup", "modal", "overlay", "banner", "widget", "masthead", "copyright", "disclaimer", "disqus", "outbrain", "taboola",
                    "teaser", "paywall", "dropdown", "footer", "sitemap")
WEAK_NAMES = frozenset("meta tags top bottom latest byline form search header".split())
CONTENT_NAMES = frozenset("article content main post entry story body text page".split())
#: Headings and short lines that open what is not the article, in some languages.
CUES = re.compile(
    r"\b(?:comments?|repl(?:y|ies)|related|recommended|newsletter|subscribe|advertisements?|sponsored|follow us|share this|read more|read next|you may also|"
    r"more from|most read|trending|popular posts|log ?in|sign ?(?:in|up)|about the author|all rights reserved|privacy policy|terms of use|"
    r"kommentare?|verwandte|mehr zum thema|weitere artikel|anzeige|werbung|anmelden|teilen|impressum|datenschutz|alle rechte vorbehalten|"
    r"commentaires?|articles liés|à lire aussi|publicité|partager|s'abonner|mentions légales|tous droits réservés|"
    r"comentarios?|artículos relacionados|publicidad|compartir|suscr[ií]bete|aviso legal|todos los derechos reservados)\b", re.I)
#: Whole headings that open such a part.
HEADINGS = re.compile(
    r"(?:\d+ )?(?:reader |user )?(?:comments?|replies|responses|leave a (?:reply|comment)|post a comment|join the (?:discussion|conversation)|"
    r"related(?: (?:articles?|posts?|stories|content|news|links|topics|reading))?|recommended(?: for you| reading)?|you (?:may|might) also like|"
    r"more (?:from|stories|articles|news)\b.*|most (?:read|popular)|popular posts|latest(?: (?:news|posts|articles))?|trending(?: now)?|newsletter|subscribe\b.*|"
    r"sign up\b.*|follow us\b.*|share(?: this.*)?|advertisements?|sponsored(?: content)?|about the author|"
    r"kommentare?|ähnliche (?:artikel|beiträge)|verwandte (?:artikel|themen)|mehr zum thema|weitere artikel|anzeige|werbung|"
    r"commentaires?|articles (?:liés|similaires|connexes)|à lire aussi|publicité|"
    r"comentarios?|artículos relacionados|te puede interesar|publicidad)\W*(?:\d+\W*)?", re.I)
NOTICE = re.compile(r"\bcookies?\b|©|\bcopyright\b", re.I)
ENDS = tuple(".!?…:;\"”»')。！？")

# Classifier: log-odds in hundredths. Smoothness: what two labels that differ cost.
BY_TAG = {"p": 60, "h1": 150, "h2": 60, "h3": 40, "blockquote": 60, "pre": 60, "figcaption": 40, "li": -40, "td": -20, "th": -20, "label": -150, "legend": -150,
          "summary": -40, "address": -100}
FIRST_WORD, PER_DOUBLING, MOST_DOUBLINGS = -150, 40, 8
SENTENCE, ALL_LINKS, CUE, SAID_NOTICE = 60, -400, -200, -250
IN_ARTICLE, IN_MAIN, IN_NAMED, OUTSIDE = 500, 300, 200, -300
APART, APART_NAMED, APART_WEAK, HIDDEN, UNDER_CUE = -700, -600, -250, -900, -600
NEXT, SECTION, PARENT = 220, 80, 40


@dataclass
class Page:
    """Elements as parallel lists, parents before children, and blocks in page order."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    mark: list[tuple[int, int]] = field(default_factory=list)
    blocks: list[tuple[str, float, int]] = field(default_factory=list)


def marks(attributes: str) -> tuple[int, int]:
    """What an element's own names say: a penalty (0: none), and whether it is called the
    main part (2 by role, 1 by name, 0 not)."""
    values: dict[str, str] = {}
    for name, *quoted in ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), next((v for v in quoted if v), ""))
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return HIDDEN, 0
    role = values.get("role", "").lower()
    if role in APART_ROLES:
        return APART, 0
    if role in ("main", "article"):
        return 0, 2
    parts = [p.lower() for p in NAME_PARTS.findall(f"{values.get('class', '')} {values.get('id', '')}")]
    if any(p in ("has", "with", "no", "without") for p in parts):
        return 0, 0
    main = any(p in CONTENT_NAMES for p in parts)
    apart = [p for p in parts if p in APART_NAMES or p.startswith(APART_BEGINNINGS)]
    if not apart:
        return 0, int(main)
    if all(p in WEAK_NAMES for p in apart):
        return (0, 0) if main else (APART_WEAK, 0)
    return APART_NAMED, 0


def read_page(source: str) -> Page:
    """Blocks and elements of a page. Tags need not be closed, and the page may end anywhere."""
    page = Page([""], [-1], [0], [(0, 0)])
    known: dict[str, tuple[int, int]] = worker_value("html_cut.marks", dict)
    stack, open_tags = [0], {}
    text: list[str] = []
    linked = silent = at = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            words = " ".join(raw.split())
            if words:
                page.blocks.append((words, linked / len(raw), stack[-1]))
            text.clear()
        linked = 0

    def close() -> None:
        nonlocal silent
        flush()
        name = page.tag[stack.pop()]
        open_tags[name] -= 1
        silent -= name in SILENT

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            if "&" in piece:
                piece = html.unescape(piece)
            text.append(piece)
            if in_link:
                linked += len(piece)

    size = len(source)
    while at < size:
        token = TOKEN.search(source, at)
        if token is None:
            add(source[at:])
            break
        add(source[at:token.start()])
        at = token.end()
        end, start, attributes = token.groups()
        if start is not None:
            name = start.lower()
            if name in VOID:
                if name in ("br", "hr"):
                    add(" ")
                continue
            if name == "body" or (open_tags.get("head") and name not in IN_HEAD):
                while open_tags.get("head"):
                    close()
            if name in RAW:
                last = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = last.start() if last else size
                continue
            if name == "a":
                in_link = True
            own = (0, 0)
            if attributes and name not in ("html", "body") and TELLING.search(attributes):
                own = known.get(attributes)
                if own is None:
                    if len(known) > 20_000:
                        known.clear()
                    own = known[attributes] = marks(attributes)
            if name in INLINE and own[0] > APART_NAMED:
                continue
            if name not in INLINE and page.tag[stack[-1]] == "p":
                close()
            closed = CLOSES.get(name, ())
            while page.tag[stack[-1]] in closed:
                close()
            flush()
            stack.append(len(page.tag))
            page.tag.append(name)
            page.parent.append(stack[-2])
            page.depth.append(page.depth[stack[-2]] + 1)
            page.mark.append(own)
            open_tags[name] = open_tags.get(name, 0) + 1
            silent += name in SILENT
        elif end is not None:
            name = end.lower()
            if name == "a":
                in_link = False
            if open_tags.get(name):
                while page.tag[stack[-1]] != name:
                    close()
                close()
                if name not in INLINE:
                    in_link = False
    flush()
    return page


def _within(page: Page) -> list[int]:
    """For each element its context: the score its place gives the blocks in it."""
    n = len(page.tag)
    size = [0] * n
    for words, link, e in page.blocks:
        size[e] += int(len(words) * (1 - link))
    for e in range(n - 1, 0, -1):
        size[page.parent[e]] += size[e]
    # The part called the article: by tag or role, else by name; the largest outside of what is apart.
    apart = [False] * n
    best: dict[int, int] = {}
    for e in range(1, n):
        tag, (penalty, main) = page.tag[e], page.mark[e]
        apart[e] = apart[page.parent[e]] or tag in ("nav", "footer", "aside") or penalty in (APART, HIDDEN)
        kind = 3 if tag == "article" or (main == 2 and tag != "main") else 2 if tag == "main" or main == 2 else main
        if kind and not apart[e] and penalty == 0 and size[e] > 0 and (kind not in best or size[e] > size[best[kind]]):
            best[kind] = e
    chosen = {best[k]: v for k, v in ((3, IN_ARTICLE), (2, IN_MAIN)) if k in best}
    outside = OUTSIDE if chosen else 0
    if not chosen and 1 in best:
        chosen[best[1]] = IN_NAMED
    around: set[int] = set()
    for e in chosen:
        while e > 0:
            around.add(e)
            e = page.parent[e]
    score = [outside] * n
    penalties = [0] * n
    held = [0] * n
    for e in range(1, n):
        tag, up = page.tag[e], page.parent[e]
        held[e] = max(held[up], chosen.get(e, 0))
        penalty = page.mark[e][0]
        if tag in APART_TAGS and not (tag == "header" and held[e]):
            penalty = min(penalty, APART)
        if e in around:
            penalty = 0
        penalties[e] = min(penalties[up], penalty)
        score[e] = penalties[e] if penalties[e] <= APART_NAMED else penalties[e] + (held[e] or outside)
    return score


def _under_cues(page: Page) -> set[int]:
    """Blocks behind a heading that opens comments, adverts and the like: to the end of its
    parent, or to the next heading there of no lower rank."""
    found: set[int] = set()
    under: list[tuple[int, int, int]] = []
    for i, (words, _, e) in enumerate(page.blocks):
        if under:
            path, up = set(), e
            while up > 0:
                path.add(up)
                up = page.parent[up]
            path.add(0)
        rank = int(page.tag[e][1]) if page.tag[e] in ("h1", "h2", "h3", "h4", "h5", "h6") else 0
        under = [(p, r, d) for p, r, d in under if p in path and not (rank and rank <= r and page.parent[e] == p)] if under else under
        if rank > 1 and len(words) <= 60 and HEADINGS.fullmatch(words):
            under.append((page.parent[e], rank, i))
        if under:
            found.add(i)
    return found


def scores(page: Page) -> list[int]:
    """Each block's log-odds of being content, in hundredths."""
    place, cued = _within(page), _under_cues(page)
    out = []
    for i, (words, link, e) in enumerate(page.blocks):
        n = words.count(" ") + 1
        value = BY_TAG.get(page.tag[e], 0) + FIRST_WORD + min(PER_DOUBLING * (n.bit_length() - 1), PER_DOUBLING * MOST_DOUBLINGS)
        value += place[e] + int(ALL_LINKS * min(link, 1.0))
        if words.endswith(ENDS):
            value += SENTENCE
        if n <= 12 and CUES.search(words):
            value += CUE
        if n <= 60 and NOTICE.search(words):
            value += SAID_NOTICE
        if i in cued:
            value += UNDER_CUE
        out.append(value)
    return out


def edges_of(page: Page) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of nodes (blocks, then sections) and weighted edges between them."""
    nodes: dict[int, int] = {}
    edges: list[tuple[int, int, int]] = []
    total = len(page.blocks)

    def section(e: int) -> int:
        nonlocal total
        while e > 0 and page.tag[e] in LEAVES:
            e = page.parent[e]
        if e in nodes:
            return nodes[e]
        chain = []
        while e not in nodes:
            chain.append(e)
            nodes[e] = total
            total += 1
            if e == 0:
                break
            e = page.parent[e]
            while e > 0 and page.tag[e] in LEAVES:
                e = page.parent[e]
        for a, b in zip(chain, [*chain[1:], e]):
            if a != b:
                edges.append((nodes[a], nodes[b], PARENT))
        return nodes[chain[0]]

    before = -1
    for i, (_, _, e) in enumerate(page.blocks):
        edges.append((i, section(e), SECTION))
        if i:
            a, b, steps = before, e, 0
            while a != b and steps < 6:
                if page.depth[a] >= page.depth[b]:
                    a = page.parent[a]
                else:
                    b = page.parent[b]
                steps += 1
            edges.append((i - 1, i, NEXT // (1 + steps)))
        before = e
    return total, edges


def smallest_cut(score: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: a node with positive score pays it when False, one with negative
    when True, an edge between different labels its weight. Of several, the fewest are True.

    Nodes that outweigh all their edges are decided first and pass those edges on as scores
    of their neighbours, which changes no cost; the rest are separated by maximum flow along
    shortest paths of the residual graph.
    """
    n = len(score)
    score = list(score)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    load = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        v = todo.pop()
        if label[v] is not None:
            continue
        if score[v] > load[v]:
            sign = 1
        elif -score[v] >= load[v]:
            sign = -1
        else:
            continue
        label[v] = sign > 0
        for u, w in near[v].items():
            score[u] += sign * w
            load[u] -= w
            del near[u][v]
            todo.append(u)
        near[v] = {}
    rest = [v for v in range(n) if label[v] is None]
    if not rest:
        return [bool(x) for x in label]
    # Distances to a node that still takes flow; flow goes from nodes with supply down them.
    while True:
        far = {v: 0 for v in rest if score[v] < 0}
        queue = deque(far)
        while queue:
            v = queue.popleft()
            for u in near[v]:
                if u not in far and near[u].get(v, 0) > 0:
                    far[u] = far[v] + 1
                    queue.append(u)
        sources = [v for v in rest if score[v] > 0 and v in far]
        if not sources:
            break
        left = {}
        for s in sources:
            while score[s] > 0:
                path = [s]
                while path and not (score[path[-1]] < 0):
                    v = path[-1]
                    if v not in left:
                        left[v] = [u for u in near[v] if far.get(u) == far[v] - 1]
                    options = left[v]
                    while options and near[v][options[-1]] <= 0:
                        options.pop()
                    if options:
                        path.append(options[-1])
                    else:
                        path.pop()
                        if path:
                            left[path[-1]].pop()
                if not path:
                    break
                flow = min(score[s], -score[path[-1]], *(near[a][b] for a, b in zip(path, path[1:])))
                score[s] -= flow
                score[path[-1]] += flow
                for a, b in zip(path, path[1:]):
                    near[a][b] -= flow
                    near[b][a] = near[b].get(a, 0) + flow
    reached = {v for v in rest if score[v] > 0}
    queue = deque(reached)
    while queue:
        v = queue.popleft()
        for u, w in near[v].items():
            if w > 0 and u not in reached:
                reached.add(u)
                queue.append(u)
    return [bool(x) if x is not None else v in reached for v, x in enumerate(label)]


def main_text(source: str) -> str:
    """The blocks of a page that the cut leaves on the side of content, joined by one space."""
    page = read_page(source)
    if not page.blocks:
        return ""
    total, edges = edges_of(page)
    score = scores(page)
    label = smallest_cut(score + [0] * (total - len(score)), edges)
    return " ".join(words for (words, _, _), keep in zip(page.blocks, label) if keep)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of each in place of its markup; all other columns stay.

    Null and empty pages give an empty text, and so do pages without content. Whole pages
    are read, whatever their length; broken and cut markup is read as browsers do, as far as
    text is concerned. Repeated rows get equal results; an empty table gives an empty one.
    A column already named like the text is replaced.
    """
    others = [c for c in pages.columns if c.lower() not in (html.lower(), into.lower())]
    # Positions in place of names, which may clash.
    rows = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), whole_text(html).alias("page"))
    schema = ", ".join([*(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(others))), "page string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch["page"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(others)), F.col("page").alias(into))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
