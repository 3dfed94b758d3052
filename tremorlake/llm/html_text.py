"""Main text of web pages by block rules in two passes.

Pass one looks at each block alone: marked-up boilerplate and links make it bad, length and
the density of stop words make it good, and the rest stays open. Where the stop words say
nothing (other scripts, other languages) length with few links makes it good. Pass two lets open blocks
inherit the label of their nearest decided neighbours, those of their own section first.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import map_batches

SHORT, LONG = 70, 200  #: characters below which a block is short, from which on it is long
MANY_LINKS = 0.35  #: share of a block's characters inside links
STOP_LOW, STOP_HIGH = 0.08, 0.16  #: share of a block's words that are stop words
FAR = 1000  #: what a neighbour in another section counts as further away

# Frequent function words of languages of the web.
STOP_WORDS = frozenset("""
a an and are as at be by for from has have he her his in is it its not of on or our she that the their they this to was were which will with you
der die das und ist nicht ein eine einen dem den des mit von zu auf für im sich auch als an es er sie wir wie bei nach aus oder wird sind
le la les un une et est dans pour pas que qui sur avec par ce cette il elle nous vous se au aux du de en ne plus ou sont son sa
el los las una y es no por con para su se al del lo como más pero sus o ha este esta son entre
il lo gli un uno e non per con che di da si sono della del nel anche come
o os um uma não com do da em no na mais ao dos das foi
een het van en niet dat op te zijn met voor aan hij ook
""".split())
# Elements whose content is not markup.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
_OPEN = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
_OPEN_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")  # where a quote is not closed
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
# Roles that class names and ids tell of, and words that may stand behind one.
ROLES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notification popup modal overlay
    newsletter subscribe subscription signup share sharing social related recommended sidebar widget menu navbar nav navigation breadcrumb breadcrumbs footer masthead
    comment comments commentlist respond replies disqus login search toolbar pagination pager skip disclaimer hidden""".split())
BEHIND = frozenset("""area article articles author avatar bar block body bottom box btn button buttons card cards col column container content date entry feed field fields form frame
    group head header heading holder icon icons image img inner input items item label layer left line link links list main media message meta middle mobile module name outer panel
    placeholder policy post posts rail region right row section slot stories story strip text thread title tools top unit wide wrap wrapper zone""".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_a-zA-Z]+")
#: Parts of class names that tell of a page's state, as in has-sidebar or comments-open, not of an element's role.
_STATE, _STATE_END = frozenset("has with without no".split()), frozenset("open closed enabled disabled active on off".split())
_ROLE = re.compile(r"^(navigation|banner|contentinfo|complementary|search|dialog|alert|menu|menubar)$", re.I)
_HEADER = frozenset(("header",))
BAD_TAGS = frozenset("nav footer aside button menu dialog head label fieldset svg math canvas object select datalist audio video".split())
WRAPPER = 0.5  #: share of a page's unmarked text from which on a form is the page's wrapper, not a form
MAIN_TAGS = frozenset(("article", "main"))
CONTAINERS = frozenset("div section article main aside nav header footer form ul ol dl table figure body html head button menu dialog label fieldset blockquote svg math canvas object select datalist audio video".split())
BREAKS = CONTAINERS | frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre tr td th caption figcaption hr address details summary center thead tbody tfoot option optgroup".split())
SECTIONS = frozenset("article main aside nav header footer section form".split())


def _names(value: str) -> list[list[str]]:
    """The class names of an attribute in lower-case parts, without those that only tell of a page's state."""
    keep = []
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and not (len(parts) > 1 and (_STATE & set(parts) or parts[-1] in _STATE_END)):
            keep.append(parts)
    return keep


def _role(parts: list[str], roles: frozenset[str]) -> bool:
    """Whether a name is that of a role: it ends in one (site-footer), or begins with one and says nothing else (footer-links, comment-42)."""
    return parts[-1] in roles or (parts[0] in roles and all(p in BEHIND or p in roles or p.isdigit() for p in parts[1:]))


def _marked(tag: str, attributes: str, inside_main: bool) -> bool:
    """Whether markup says that an element is not part of the article."""
    if tag in BAD_TAGS or (tag == "header" and not inside_main):
        return True
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if any(_role(parts, ROLES) or (not inside_main and _role(parts, _HEADER)) for parts in _names(value)):
                return tag not in ("body", "html", "article", "main")
        elif name == "role" and _ROLE.match(value):
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return False


class _Blocks:
    """Blocks of one page: [text, characters in links, marked, in the article, section]."""

    def __init__(self, html: str):
        self.found: list[tuple[str, int, bool, bool, int]] = []
        self.text: list[str] = []
        self.links, self.in_link, self.marked_block, self.breaks, self.sections = 0, 0, False, 0, 0
        self.stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
        self.forms: list[list] = []  # [open, in the article or holding it, blocks] of each form
        self.scan(html)
        self.flush()
        self.judge_forms()

    def scan(self, html: str) -> None:
        """One pass from left to right; every step goes on behind what it has read."""
        at, text = 0, 0
        while (at := html.find("<", at)) >= 0:
            kind, end, tag = html[at + 1:at + 2], at + 1, None
            if html.startswith("<!--", at):
                short = next((len(e) for e in ("<!-->", "<!--->") if html.startswith(e, at)), 0)
                stop = None if short else _COMMENT_END.search(html, at + 4)
                end = at + short if short else stop.end() if stop else len(html)
            elif kind in ("!", "?") or (kind == "/" and not html[at + 2:at + 3].isalpha()):
                end = html.find(">", at) + 1 or len(html)
            elif kind == "/" or kind.isalpha():
                tag = _OPEN.match(html, at) or _OPEN_PLAIN.match(html, at)
                if tag is None:  # not closed before the next tag: it is text
                    at += 1
                    continue
                end = tag.end()
            else:
                at += 1
                continue
            if at > text:
                self.add(html[text:at])
            if tag is not None:
                name = tag[2].lower()
                if name in RAW and not tag[1]:
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(html, end)
                    end = close.end() if close else len(html)
                elif name not in RAW:
                    self.tag(name, tag[1] == "/", tag[3])
            at = text = end
        if text < len(html):
            self.add(html[text:])

    def judge_forms(self) -> None:
        """Mark the blocks of forms, but of those that wrap the page or its article."""
        if not self.forms:
            return
        size = lambda blocks: sum(len(b[0]) for b in blocks if not b[2] and not _link_dense(b[0], b[1]))
        least = WRAPPER * size(self.found)
        bad = {i for _, main, blocks in self.forms if not main and (size(map(self.found.__getitem__, blocks)) < least or not least) for i in blocks}
        self.found = [(b[0], b[1], b[2] or i in bad, b[3], b[4]) for i, b in enumerate(self.found)]

    def add(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.text.append(text)
        if text.strip():
            self.breaks = 0
            if self.in_link:
                self.links += len(" ".join(text.split()))

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, marked, main, section = self.stack[-1]
            inner = next((f for f in reversed(self.forms) if f[0]), None)
            if inner:
                inner[2].append(len(self.found))
            self.found.append((text, self.links, marked or self.marked_block, main, section))
        self.text, self.links, self.marked_block, self.breaks = [], 0, False, 0

    def tag(self, tag: str, closing: bool, attributes: str) -> None:
        if tag == "a":
            self.in_link = 0 if closing else 1
        elif tag == "br":
            self.breaks += 1
            self.text.append(" ")
            if self.breaks > 1:
                self.flush()
        elif tag in BREAKS:
            self.flush()
            self.in_link = 0 if closing and tag in CONTAINERS else self.in_link
            if tag in CONTAINERS:
                self.container(tag, closing, attributes)
            elif not closing and attributes:
                self.marked_block = _marked(tag, attributes, self.stack[-1][2])

    def container(self, tag: str, closing: bool, attributes: str) -> None:
        if closing:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    for name, *_ in self.stack[i:]:
                        if name == "form":
                            next(f for f in reversed(self.forms) if f[0])[0] = False
                    del self.stack[i:]
                    break
            return
        _, marked, main, section = self.stack[-1]
        own = _marked(tag, attributes, main)
        if tag in SECTIONS or own:
            self.sections += 1
            section = self.sections
        if not attributes.endswith("/"):
            self.stack.append((tag, marked or own, main or tag in MAIN_TAGS, section))
            if tag == "form":
                self.forms.append([True, False, []])
            elif tag in MAIN_TAGS and not (marked or own):
                for form in self.forms:
                    form[1] = form[1] or form[0]


_WIDE = re.compile("[\u3000-\u30ff\u3400-\u9fff\uac00-\ud7af\uff00-\uffef\U00020000-\U0003ffff]")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
LISTED = 0.2  #: share of a page's Latin-script text in blocks full of stop words from which on its language counts as listed


def _size(text: str) -> int:
    """Characters, where one of Chinese, Japanese or Korean counts as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def _latin(text: str) -> bool:
    """Whether most letters are Latin."""
    return text.isascii() or 2 * len(_LATIN.findall(text)) >= sum(map(str.isalpha, text))


def _density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def _link_dense(text: str, links: int) -> bool:
    return links > MANY_LINKS * len(text)


def _unlisted(blocks: list) -> bool:
    """Whether the Latin-script text of a page is in a language without stop words in the list."""
    total = prose = 0
    for text, links, marked, *_ in blocks:
        if not marked and len(text) >= SHORT and not _link_dense(text, links) and _latin(text):
            total += len(text)
            prose += len(text) * (_density(text) >= STOP_HIGH)
    return prose < LISTED * total


def _first_pass(text: str, links: int, marked: bool, main: bool, unlisted: bool = False) -> int:
    """1 good, -1 bad, 0 open."""
    if marked or _link_dense(text, links):
        return -1
    size = _size(text)
    if size < SHORT:
        return 0
    if unlisted or not _latin(text):
        return 1 if size >= LONG or main else 0
    density = _density(text)
    if density >= STOP_HIGH and (size >= LONG or main):
        return 1
    if density >= STOP_LOW or main:
        return 0
    return -1


def _second_pass(blocks: list, labels: list[int]) -> list[bool]:
    """Labels of open blocks from the nearest decided neighbours; in a tie the article's side wins.

    For open blocks of the article, blocks that are bad for their links alone are no neighbours.
    """
    n = len(blocks)
    before, after = [(-1, 0)] * n, [(-1, 0)] * n

    def sweep(order, out) -> None:
        last = ({}, {})  # for blocks outside and inside the article: by section, and under None of all
        for i in order:
            if labels[i]:
                last[0][None] = last[0][blocks[i][4]] = i
                if labels[i] > 0 or blocks[i][2]:
                    last[1][None] = last[1][blocks[i][4]] = i
            else:
                seen = last[bool(blocks[i][3])]
                own = seen.get(blocks[i][4])
                pick = own if own is not None else seen.get(None)
                out[i] = (-1, 0) if pick is None else (abs(i - pick) + (0 if own is not None else FAR), labels[pick])

    sweep(range(n), before)
    sweep(range(n - 1, -1, -1), after)
    out = []
    for i, b in enumerate(blocks):
        if labels[i]:
            out.append(labels[i] > 0)
            continue
        near = [x for x in (before[i], after[i]) if x[0] >= 0 and not (b[3] and x[0] >= FAR)]
        if not near:
            out.append(b[3] or len(b[0]) >= SHORT)
        else:
            least = min(x[0] for x in near)
            votes = {x[1] for x in near if x[0] == least}
            out.append(1 in votes if len(votes) == 1 else b[3])
    return out


def extract(html: str | None) -> str:
    """The article's blocks in page order, joined by two line breaks; empty for a null or empty page."""
    blocks = _Blocks(html or "").found
    unlisted = _unlisted(blocks)
    labels = [_first_pass(*b[:4], unlisted) for b in blocks]
    return "\n\n".join(b[0] for b, keep in zip(blocks, _second_pass(blocks, labels)) if keep)


def main_text(pages: DataFrame, keep: list[str] | None = None, html: str = "html") -> DataFrame:
    """The columns ``keep`` (all others by default), ``text`` and ``n_chars`` of every page.

    A null or empty page has an empty text. Repeated pages are rows of their own; an empty
    table gives an empty result; columns named ``text`` or ``n_chars`` are replaced unless
    they are in ``keep``. Time and memory are in proportion to a page's length.
    """
    columns = [c for c in pages.columns if c not in (html, "text", "n_chars")] if keep is None else keep
    held = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(html).cast("string").alias("_html"))

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([extract(h) for h in b.column("_html").to_pylist()], pa.string())], names=[*b.schema.names[:-1], "_text"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in held.drop("_html").schema), "_text string"])
    return map_batches(held, of, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("_text").alias("text"), F.length("_text").cast("bigint").alias("n_chars"))
