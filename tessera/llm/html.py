"""Main text of web pages by equivalence-class template deduction.

Pages of one host are instances of a template. Every page becomes a sequence of tokens: an element with its path, or a
whole text with its path. Tokens that occur equally often on every page of the host, so share an occurrence vector, form
an equivalence class (Arasu and Garcia-Molina). A vector is held as its support, its total and a 62-bit sum of hashes of
(page, count), which adds up over partitions: a host with a third of all pages is one aggregation key among others and is
combined before the shuffle.

Classes with an element among them, on most pages, are valid. They nest by their elements' paths into the template: a
tree whose nodes are the elements that pages have, those of classes with one occurrence a page being its slots. The
article is the slot that holds most of the text that is neither a link nor the template's own: from the root the tree is
followed down as long as one slot has most of it. Within the article, texts that are tokens of a valid class on nearly
every page are the site's own and go, and so do slots of links. Both are decided over all pages of a host, whatever their
number; for hosts of a few pages the same paths on all other hosts are prior evidence.

A slot that a name, class or role gives to the site or the readers (comments, sidebars, forms, notices) is no article while
any other slot has text, and its text, however long, neither counts for the slots around it nor stays in the article. What
an element rules out by itself (scripts, <nav>, hidden ones) never counts.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"head", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "object", "svg", "canvas", "math", "dialog", "menu", "audio", "video", "map", "datalist", "script", "style", "title", "textarea", "iframe"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"html", "body", "article", "main", "section", "div", "ul", "ol", "dl", "table", "blockquote", "td", "th", "nav", "aside", "footer", "header", "form"}
SITE = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menus?|breadcrumbs?|masthead|header|footer|foot|sidebars?|aside|ads?|adv|adverts?|advertis\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter"
    r"|subscri\w*|social|shar(?:e|ing)\w*|related|recommend\w*|trending|widgets?|login|signin|signup|register|search\w*|forms?|pagination|pager|toolbar|skip\w*|copyright|legal|disclaimer|tagcloud|hidden|sr-only)(?:$|[\s_-])"
)
SAYS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|comment\w*|disqus\w*|respond|repl(?:y|ies)|discussion|reviews?|guestbook)(?:$|[\s_-])")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMED = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<=\s)(hidden)(?=[\s/]|$)""")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _signs(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(text)} if "=" in text or "hidden" in text else {}


HARD, SOFT = 2, 1
ARTICLE = ("article", "main")
CONTENT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "figure", "figcaption", "picture", "blockquote", "pre", "ul", "ol", "dl", "table", "address", "hgroup"}


def _label(tag: str, signs: dict[str, str]) -> int:
    """HARD: never the article; SOFT: a name says that it is the site's or the readers', not the article."""
    if tag in NEVER:
        return SOFT if tag == "form" else HARD
    if not signs:
        return 0
    if "hidden" in signs or signs.get("role", "").lower() in ROLES or signs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", signs.get("style", "")):
        return HARD
    own = f"{signs.get('class', '')} {signs.get('id', '')}".lower()
    return SOFT if tag not in ("html", "body", "main") and (SAYS.search(own) or tag != "article" and SITE.search(own)) else 0


class Node:
    """The elements of one path on a page: how many there are, and the characters of text and of links inside them."""

    __slots__ = ("chars", "count", "hard", "label", "links", "parent", "path", "place", "tag")

    def __init__(self, path: int, parent: Node | None, tag: str, label: int, place: int):
        self.path, self.parent, self.tag, self.label, self.place = path, parent, tag, label, place
        self.hard = label == HARD or parent is not None and parent.hard
        self.count = self.chars = self.links = 0

    def chain(self) -> Iterator[Node]:
        at: Node | None = self
        while at is not None:
            yield at
            at = at.parent


class Block:
    __slots__ = ("links", "node", "text")

    def __init__(self, node: Node, text: str, links: int):
        self.node, self.text, self.links = node, text, links


def parse(page: str) -> tuple[list[Block], dict[int, Node]]:
    """Blocks of text in page order, and the page's elements by path. Broken markup is taken as it comes."""
    root = Node(0, None, "", 0, 0)
    root.count = 1
    blocks: list[Block] = []
    nodes = {0: root}
    stack: list[tuple[str, Node]] = [("", root)]
    held: list[str] = []
    linked = link_depth = at = 0
    end = len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                blocks.append(Block(stack[-1][1], text, min(linked, len(text))))
        linked = 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            part = entities.unescape(page[at:lt])
            held.append(part)
            if link_depth:
                linked += len(part)
        if lt == end:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!":
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = end if close < 0 else close + 3
            else:
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            continue
        if nxt == "?":
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        if not (nxt.isalpha() or nxt == "/"):
            held.append("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt) or LOOSE.match(page, lt)
        if not m:
            close = page.find(">", lt) if nxt == "/" else -1
            if nxt == "/" and close < 0 or nxt != "/":
                break  # the page ends inside a tag
            at = close + 1
            continue
        at = m.end()
        closing, tag = m[1], m[2].lower()
        if tag == "br" or tag == "hr":
            held.append("\n")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if inline and held and stack[k][1] is not stack[k - 1][1]:
                        flush()
                    del stack[k:]
                    break
                if stack[k][0] in HOLDERS and (inline or tag not in HOLDERS):
                    break
            link_depth = any(t == "a" for t, _ in stack) if tag == "a" or not inline else link_depth
            continue
        signs = _signs(m[3])
        if not inline and tag not in VOID:
            while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ())):
                stack.pop()
            shut = CLOSES.get(tag)
            if shut:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in shut:
                        del stack[k:]
                        break
                    if stack[k][0] in HOLDERS:
                        break
        outer = stack[-1][1]
        label = _label(tag, signs)
        if tag == "header" and not any(t in ARTICLE for t, _ in stack):
            label = max(label, SOFT)
        if tag in VOID:
            continue
        own = outer
        if not inline or label or tag in RAW:
            here = xxhash.xxh3_64_intdigest(f"{outer.path}/{tag}.{signs.get('class', '')}#{signs.get('id', '')}!{label}")
            own = nodes.get(here)
            if own is None:
                own = nodes[here] = Node(here, outer, tag, label, len(nodes))
            own.count += 1
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end if not close else close.start()
            if not close:
                break
            skip = page.find(">", at)
            at = end if skip < 0 else skip + 1
            continue
        if inline and own is not outer:
            flush()
        if not m[3].rstrip().endswith("/") or tag not in ("svg", "math", "path"):
            stack.append((tag, own))
            link_depth = link_depth or tag == "a"
    flush()
    _keep_only_article(nodes)
    for b in blocks:
        if not b.node.hard:
            for n in b.node.chain():
                n.chars += len(b.text)
                n.links += b.links
    return blocks, nodes


def _keep_only_article(nodes: dict[int, Node]) -> None:
    """A page's one <article> or <main> is no part of what a name around it says; of several, those outside such parts are meant."""
    found = [n for n in nodes.values() if n.tag in ARTICLE and not n.label]
    if len(found) == 1:
        for n in found[0].chain():
            n.label = 0 if n.label == SOFT else n.label


def text_token(block: Block) -> int:
    return xxhash.xxh3_64_intdigest(block.text, seed=block.node.path)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


FIELDS = ("support", "total", "v1", "v2", "place", "chars", "links", "parent", "label")


def page_tokens(blocks: list[Block], nodes: dict[int, Node]) -> dict[int, tuple]:
    """Of each token of a page: is it a text, its count, first place, characters (of a text: of all its occurrences), those of links, the path around it, tag and label."""
    out = {n.path: (False, n.count, n.place, n.chars, n.links, n.parent.path if n.parent else 0, n.tag, n.label) for n in nodes.values()}
    seen: dict[int, list] = {}
    for i, b in enumerate(blocks):
        if not b.node.hard:
            s = seen.setdefault(text_token(b), [0, i, 0, 0, b.node.path])
            s[0] += 1
            s[2] += len(b.text)
            s[3] += b.links
    return out | {k: (True, *s, "", 0) for k, s in seen.items()}


def occurrence_vectors(pages: DataFrame, id_col: str, url_col: str, html_col: str, flush_at: int = 100_000) -> DataFrame:
    """(host, token, is_text, tag, FIELDS): occurrence vectors, summed first places, characters and links, combined in each task before the shuffle. Pages without tokens are no instances."""
    rows = pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), _host(url_col), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}

        def out():
            keys, rows = list(seen), list(seen.values())
            cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64()), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string())]
            cols += [pa.array([_signed(r[i]) if i == 9 else r[i] for r in rows], pa.int64()) for i in range(2, 11)]
            seen.clear()
            return pa.RecordBatch.from_arrays(cols, names=["host", "token", "is_text", "tag", *FIELDS])

        for b in batches:
            for id_, host, page in zip(*(b.column(i) for i in range(3)), strict=True):
                who, h = xxhash.xxh3_64_intdigest(id_.as_py()), host.as_py()
                tokens = page_tokens(*parse(page.as_py() or ""))
                if len(tokens) == 1:
                    continue
                for token, (is_text, count, place, chars, links, parent, tag, label) in tokens.items():
                    mark = xxhash.xxh3_64_intdigest(count.to_bytes(8, "little"), seed=who)
                    s = seen.get((h, token))
                    if s is None:
                        s = seen[h, token] = [is_text, tag, 0, 0, 0, 0, 0, 0, 0, parent, label]
                    s[2] += 1
                    s[3] += count
                    s[4] += mark & 0x7FFFFFFF
                    s[5] += mark >> 33
                    s[6] += place
                    s[7] += chars
                    s[8] += links
                if len(seen) > flush_at:
                    yield out()
        if seen:
            yield out()

    parts = rows.mapInArrow(run, "host string, token long, is_text boolean, tag string, " + ", ".join(f"{f} long" for f in FIELDS))
    sums = [F.sum(c).alias(c) for c in FIELDS[:-2]] + [F.max(c).alias(c) for c in FIELDS[-2:]]
    return parts.groupBy("host", "token", "is_text", "tag").agg(*sums)


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit(""))).alias("host")


def host_tokens(vectors: DataFrame, least_share: float = 0.5) -> DataFrame:
    """(host, pages, tokens): of each host the tokens on at least least_share of its pages; of texts those on two pages or more.

    At most 1 / least_share times the tokens of an average page pass, so a host's list is bounded by its pages' length.
    Elements come with the characters that the same path has on an average page of all hosts.
    """
    often = vectors.filter((F.col("token") == 0) | ~F.col("is_text") | (F.col("support") > 1))
    whole = often.filter("token = 0").select("host", F.col("support").alias("pages"))
    kept = often.join(whole, "host").filter(F.col("support") >= F.col("pages") * least_share)
    kept = stash(kept, "tokens")
    pool = kept.filter("NOT is_text").groupBy("token").agg((F.sum("chars") / F.sum("support")).alias("pool_chars"), (F.sum("links") / F.sum("support")).alias("pool_links"))
    rows = kept.join(pool, "token", "left").na.fill(0.0, ["pool_chars", "pool_links"])
    own = F.struct("token", "is_text", "tag", *FIELDS, "pool_chars", "pool_links")
    return rows.groupBy("host").agg(F.first("pages").alias("pages"), F.sort_array(F.collect_list(own)).alias("tokens"))


class Slot:
    """A node of the template: an element, whether each page has it once, and the text it holds."""

    __slots__ = ("inside", "label", "links", "once", "parent", "path", "tag", "text", "varying", "whole")

    def __init__(self, path: int, parent: int, tag: str, label: int, once: bool, text: float, links: float, own: float):
        self.path, self.parent, self.tag, self.label, self.once = path, parent, tag, label, once
        self.text, self.links, self.varying = max(text - links, 0.0), links, own  # own: of the host's pages alone
        self.whole = self.text
        self.inside: list[Slot] = []


def nest(slots: dict[int, Slot]) -> Slot:
    """Nest elements by their paths; returns the root."""
    for s in slots.values():
        if s.path:
            slots[s.parent if s.parent in slots else 0].inside.append(s)
    return slots[0]


def set_apart(root: Slot) -> None:
    """Take the text of labelled slots out of themselves and all around them, if that leaves any; else labels count for nothing."""
    order, todo = [], [root]
    while todo:
        order.append(todo.pop())
        todo.extend(order[-1].inside)
    for measure in ("text", "varying"):
        lost = {}
        for s in reversed(order):
            own = max(getattr(s, measure), 0.0)
            lost[s.path] = own if s.label and s.path else min(sum(lost[k.path] for k in s.inside), own)
        if max(getattr(root, measure), 0.0) - lost[root.path] > 1e-9:
            for s in order:
                setattr(s, measure, max(getattr(s, measure) - lost[s.path], 0.0))


def article_slot(root: Slot, measure: str, most: float = 0.5) -> Slot:
    """From the root down, as long as one slot holds at least `most` of the measure; names weigh slots up or down.

    Up again where that has left headings and paragraphs beside it, or where the element around it is an <article> or <main>.
    """

    def weight(s: Slot) -> float:
        return getattr(s, measure) * (4.0 if s.tag in ARTICLE and not s.label else 0.3 if s.label else 1.0)

    above, at = [], root
    while True:
        kids = [s for s in at.inside if s.label < HARD]
        total = sum(map(weight, kids)) + max(getattr(at, measure) - sum(getattr(s, measure) for s in kids), 0.0)
        once = [s for s in kids if s.once]
        best = max(once, key=weight, default=None)
        if best is None or weight(best) <= 0 or weight(best) < most * total:
            break
        above.append(at)
        at = best
    while above:
        outer = above.pop()
        beside = [s for s in outer.inside if s is not at and not s.label]
        if outer.tag in ARTICLE or beside and at.tag not in ARTICLE and all(s.tag in CONTENT for s in beside):
            at = outer
        else:
            break
    return at


class Template:
    """What is deduced for a host: the article's slot by all text (at) and by the text that varies over pages (varying), slots of links, and texts that are the site's own.

    texts maps the text tokens of valid classes to (mean place among a page's texts, whether nearly each page has it once).
    """

    def __init__(self, pages: int, tokens: list[dict], nearly: float = 0.9, prior: float = 4.0, few: int = 10):
        prior = prior if pages < few else 0.0
        groups = defaultdict(list)
        slots: dict[int, Slot] = {}
        for t in tokens:
            groups[(t["support"], t["total"], t["v1"], t["v2"])].append(t)
            if not t["is_text"]:
                text, links = (t[k] + prior * t["pool_" + k] for k in ("chars", "links"))
                slots[t["token"]] = Slot(t["token"], t["parent"], t["tag"], t["label"], t["total"] <= 1.02 * t["support"], text, links, t["chars"] - t["links"])
        root = nest(slots)
        self.texts: dict[int, tuple[float, bool]] = {}
        for (support, total, _, _), members in groups.items():
            if any(not t["is_text"] for t in members):
                for t in members:
                    if t["is_text"]:
                        self.texts[_unsigned(t["token"])] = (t["place"] / support, support == total >= nearly * pages)
                        at = t["parent"]
                        while at in slots:
                            slots[at].varying -= max(t["chars"] - t["links"], 0)
                            at = slots[at].parent if at else None
        set_apart(root)
        self.at = _unsigned(article_slot(root, "text").path)
        self.varying = _unsigned(article_slot(root, "varying").path) if root.varying > 0 and pages > 1 else self.at
        self.links = {_unsigned(s.path) for s in slots.values() if s.once and s.path and s.links > 4 * s.whole and s.label < HARD}

    @classmethod
    def packed(cls, at: int, varying: int, links: list[int], texts: list[dict]) -> Template:
        t = cls.__new__(cls)
        t.at, t.varying, t.links = _unsigned(at), _unsigned(varying), {_unsigned(x) for x in links}
        t.texts = {_unsigned(x["token"]): (x["place"], x["nearly"]) for x in texts}
        return t


def _unsigned(x: int) -> int:
    return x & (1 << 64) - 1


def templates(found: DataFrame) -> DataFrame:
    """(host, at, varying, links, texts): the template of each host, deduced in one place from its tokens."""
    shape = "host string, at long, varying long, links array<long>, texts array<struct<token: long, place: double, nearly: boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("token", pa.int64()), ("place", pa.float64()), ("nearly", pa.bool_())])))
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b, out = whole.slice(at, 64), []
                for host, pages, tokens in zip(*(b.column(i) for i in range(3)), strict=True):
                    t = Template(pages.as_py(), tokens.as_py())
                    texts = [{"token": _signed(k), "place": p, "nearly": n} for k, (p, n) in sorted(t.texts.items())]
                    out.append((host.as_py(), _signed(t.at), _signed(t.varying), sorted(map(_signed, t.links)), texts))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["host", "at", "varying", "links", "texts"])

    return found.select("host", "pages", "tokens").mapInArrow(run, shape)


def slots_of(blocks: list[Block], fixed: dict[int, float]) -> list[Block]:
    """The blocks between the template's texts. A text counts as the template's only while the order of the class holds; out of order it belongs to its slot."""
    reached, out = -1.0, []
    for b in blocks:
        place = fixed.get(text_token(b))
        if place is None or place < reached:
            out.append(b)
        else:
            reached = place
    return out


def _size(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def own_template(nodes: dict[int, Node]) -> Template:
    """A template from one page alone: the same slots and weights, no texts."""
    tokens = [{"token": _signed(n.path), "is_text": False, "tag": n.tag, "support": 1, "total": n.count, "v1": 0, "v2": 0, "place": n.place, "chars": n.chars, "links": n.links, "parent": _signed(n.parent.path) if n.parent else 0, "label": n.label, "pool_chars": 0.0, "pool_links": 0.0} for n in nodes.values()]
    return Template(1, tokens)


def main_text(blocks: list[Block], template: Template | None) -> str:
    """Texts of the article's slot, in page order.

    A page that lacks the template's slot, or has no text of its own there, is decided by its own elements alone. Parts that a
    name gives to the site or the readers go, whatever their length, unless nothing else is left. Slots of links and the
    site's own texts go only while they are the smaller part of what is left, as what is most of an article is no label
    (pages that are copies share their articles). Where no element marks the article and the slot is the one that varies,
    texts on nearly every page go whatever their part. What varies over the pages is the page's own, too, where it is
    outside the slot that holds most of the text.
    """
    open_blocks = [b for b in blocks if not b.node.hard]
    if not open_blocks:
        return ""
    nodes = {n.path: n for b in open_blocks for n in b.node.chain()}
    clear = [b for b in open_blocks if not any(n.label for n in b.node.chain())]
    named = not clear  # the whole page is in labelled parts: labels tell nothing
    if template is None or not any(n.path == template.at for b in clear or open_blocks for n in b.node.chain()):
        template = own_template(nodes)
    article = [b for b in (open_blocks if named else clear) if any(n.path == template.at for n in b.node.chain())]
    below = {p for p in {n.path for b in article for n in b.node.chain()} if p != template.at and any(n.path == template.at for n in nodes[p].chain())}
    rest = article
    for gone in ({p for p in below if nodes[p].label}, template.links & below):
        part = [b for b in rest if not any(n.path in gone for n in b.node.chain())] if gone else rest
        if len(part) < len(rest):
            rest = part if 2 * _size(part) >= _size(rest) else _least(rest, gone)
    if template.texts:
        once = {k: p for k, (p, nearly) in template.texts.items() if nearly}
        part = slots_of(rest, once)
        marked = any(n.tag in ARTICLE for n in nodes[template.at].chain())
        if 2 * _size(part) >= _size(rest) or part and not marked and template.varying == template.at:
            rest = part
        if template.varying != template.at and template.varying in nodes:
            taken = {id(b) for b in rest}
            out = [b for b in clear if any(n.path == template.varying for n in b.node.chain()) and text_token(b) not in template.texts]
            taken |= {id(b) for b in out}
            rest = [b for b in open_blocks if id(b) in taken]
        elif template.varying == template.at:
            part = slots_of(rest, {k: p for k, (p, _) in template.texts.items()})
            if part and 2 * _size(part) >= _size(rest):
                rest = part
    return " ".join(b.text for b in rest)


def _least(blocks: list[Block], gone: set[int]) -> list[Block]:
    """Without those of the paths in `gone` that hold less than half of the blocks' text each."""
    whole, held = _size(blocks), Counter()
    for b in blocks:
        for p in {n.path for n in b.node.chain()} & gone:
            held[p] += len(b.text)
    small = {p for p in gone if 2 * held[p] < whole}
    return [b for b in blocks if not any(n.path in small for n in b.node.chain())]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text (empty if none).

    * null html: empty text; null url or one without host: pages of the host '';
    * a host of one page: its own elements and those paths on other hosts decide, as no text can be told to repeat;
    * repeated rows: each is returned, and each counts as an instance; equally heavy slots: the first in path order;
    * broken, cut-off and very long pages: parsed as they are, never cut; empty input: no rows. Other columns are not read.

    A host's template is deduced once, from tokens whose number its pages' length bounds, and joins the pages by host;
    Spark sends the templates to all executors only if their size is below its own bound.
    """
    found = stash(templates(host_tokens(occurrence_vectors(pages, id_col, url_col, html_col))), "templates")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(url_col)).join(found, "host", "left")
    rows = rows.select("page_id", "url", "html", "host", "at", "varying", "links", "texts")
    schema = rows.select("page_id", "url").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template | None] = {}
        for b in batches:
            out = []
            for page, host, *told in zip(*(b.column(i) for i in range(2, 8)), strict=True):
                h = host.as_py()
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = Template.packed(*(x.as_py() for x in told)) if told[0].is_valid else None
                out.append(main_text(parse(page.as_py() or "")[0], known[h]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    out = rows.mapInArrow(run, schema)
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text")
