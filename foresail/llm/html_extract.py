"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks of text at block-level tags. Each block has features of its
ancestors' tags and of words in their class and id, and of its text; the field labels
the sequence of blocks as content or not, and Viterbi decoding finds the best labels.
The weights are learned here, from labelled pages that ``labelled_pages`` writes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

# Tags that part blocks, tags without an end, and tags whose inside is never text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas audio video textarea math".split())
#: Tags that their own kind, or a block, ends when an end tag is missing.
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_ENDED = {tag: tuple(t for t, by in CLOSED_BY.items() if tag in by) for tag in BLOCK}

#: A quote parts an attribute's value only after an equals sign; one that nothing closes is a letter like others, so the tag ends at the next ``>``.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)(?:>|\Z)|[^<]+|<", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/"']++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*+)))?""")
#: Attributes whose words tell what a part of a page is.
_TELLING = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")

#: Words in class, id and role that tell what a part of a page is, by kind. Fixed values.
KINDS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner adsense dfp taboola outbrain",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs tab dropdown sitemap skip",
    "head": "header masthead topbar head logo branding",
    "foot": "footer foot bottom copyright colophon legal imprint",
    "side": "sidebar side aside widget widgets rail related recommended recommendation popular trending more rightcol leftcol secondary complementary",
    "comment": "comment comments commentlist disqus reply replies respond discussion reader readers feedback thread",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay warning message messages disclaimer paywall toast announcement",
    "form": "form search login signup subscribe newsletter register subscription contact signin",
    "share": "share sharing social follow like facebook twitter tweet",
    "meta": "meta byline author date tags categories posted timestamp",
    "content": "content article post entry story main body text articlebody hentry prose page",
}
_KIND = {w: k for k, words in KINDS.items() for w in words.split()}
#: Of these, the longer ones tell at a word's end too, as in ``leftsidebar``.
_ENDS = tuple(sorted(w for w in _KIND if len(w) >= 6))


def _kind(word: str) -> str | None:
    if (k := _KIND.get(word)) is None and word.endswith(_ENDS):
        k = _KIND[max((e for e in _ENDS if word.endswith(e)), key=len)]
    return k


TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "button", "label", "li", "ul", "table", "h1", "h2", "p", "div", "blockquote", "pre", "figure", "a", "title", "head", "select", "body", "dialog", "menu", "td")


@dataclass(slots=True)
class Block:
    text: str
    inside: frozenset[str]  #: the tags it stands in, of those that features look at
    last: str  #: the block-level tag next to it
    kinds: frozenset[str]
    linked: int  #: characters inside links
    hidden: bool


@dataclass(slots=True)
class _Open:
    """An open tag, with what holds for all inside it: so a block costs the same at any depth."""

    tag: str
    inside: frozenset[str]
    last: str
    kinds: frozenset[str]
    hidden: bool
    block_at: int  #: place in the stack of the last block-level tag up to here, -1 for none


_ROOT = _Open("", frozenset(), "", frozenset(), False, -1)


def _attributes(text: str) -> tuple[set[str], bool, bool]:
    """Kinds that the attributes tell, whether they hide, and whether a slash at their end closes the tag."""
    kinds: set[str] = set()
    hidden, end = False, 0
    for a in _ATTRIBUTE.finditer(text):
        name, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
        end = a.end() if a.group(4) else 0
        if name in _TELLING:
            for w in _PARTS.findall(value):
                if (k := _kind(w.lower())) is not None:
                    kinds.add(k)
        elif name == "style":
            hidden |= "display:none" in _SPACE.sub("", value).lower()
        elif name == "hidden":
            hidden |= value.lower() != "false"
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
    return kinds, hidden, text.endswith("/") and end != len(text)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with decoded references and white space made one space; never an empty one.

    Scripts, styles, comments and markup are no text. Missing and stray end tags are mended as browsers do
    in the plain cases: a new paragraph ends an open one, a stray end is skipped. The time is linear in the page,
    however deep its tags are nested and however many are never closed.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of the open tags of each name
    held: list[str] = []
    linked = 0

    def pop() -> str:
        tag = stack.pop().tag
        places[tag].pop()
        return tag

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                top = stack[-1] if stack else _ROOT
                out.append(Block(text, top.inside, top.last, top.kinds, min(linked, len(text)), top.hidden))
            held.clear()
        linked = 0

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group(0)
            if not (len(piece) > 1 and piece[0] == "<"):
                held.append(piece)
                if places.get("a"):
                    linked += len(piece)
            elif piece.startswith("<![CDATA["):
                held.append(html.escape(piece[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in BLOCK:
                flush()
            if places.get(tag) and (tag in BLOCK or stack[-1].block_at < places[tag][-1]):  # an inline end tag does not end the blocks opened since
                while pop() != tag:
                    pass
            continue
        text = m.group(3)
        kinds, hidden, closed = _attributes(text) if text else (set(), False, False)
        if tag in RAW:
            if not closed:  # what is inside is no markup: on to the end tag
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            flush()
            ended = _ENDED[tag]
            for t in ended:
                if places.get(t):
                    while stack and stack[-1].tag not in BLOCK:
                        pop()
                    while stack and stack[-1].tag in ended:
                        pop()
                    break
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            continue
        if not closed:
            top = stack[-1] if stack else _ROOT
            known = tag in _SEEN and tag not in top.inside
            places.setdefault(tag, []).append(len(stack))
            stack.append(_Open(
                tag, top.inside | {tag} if known else top.inside, tag if tag in BLOCK else top.last, top.kinds if top.kinds >= kinds else top.kinds | kinds, top.hidden or hidden,
                len(stack) if tag in BLOCK else top.block_at,
            ))
    flush()
    return out


_NUMBERS = ("words", "short", "long", "linked", "stops", "capital", "digits", "copyright", "pipes", "spoiled", "clean", "bare", "outside")
NAMES = ("bias", *(f"in_{t}" for t in TAGS), *(f"last_{t}" for t in TAGS), *(f"kind_{k}" for k in KINDS), "hidden", *_NUMBERS)
_AT = {n: k for k, n in enumerate(NAMES)}
#: Tags whose inside is rarely part of an article.
_ASIDE = frozenset("nav header footer aside form button select dialog menu title label".split())
_SEEN = _ASIDE | set(TAGS)
_STOPS = re.compile(r"[.!?…]")
_LEGAL = re.compile(r"©|\ball rights reserved\b|\bcopyright\b|\bcookies?\b|\bsubscribe\b|\bnewsletter\b|\bread more\b|\bshare\b", re.I)


def features(found: list[Block]) -> np.ndarray:
    """A row of features for each block."""
    x = np.zeros((len(found), len(NAMES)))
    holds = ["content" in b.kinds or not b.inside.isdisjoint(("article", "main")) for b in found]
    some = any(holds)
    for i, b in enumerate(found):
        row = x[i]
        row[0] = 1
        for t in b.inside:
            if (k := _AT.get(f"in_{t}")) is not None:
                row[k] = 1
        if (k := _AT.get(f"last_{b.last}")) is not None:
            row[k] = 1
        for kind in b.kinds:
            row[_AT[f"kind_{kind}"]] = 1
        row[_AT["hidden"]] = b.hidden
        words = b.text.count(" ") + 1
        size = len(b.text)
        row[_AT["words"]] = min(np.log1p(words), 6) / 3
        row[_AT["short"]] = words < 5
        row[_AT["long"]] = words > 25
        row[_AT["linked"]] = b.linked / size
        row[_AT["stops"]] = min(len(_STOPS.findall(b.text)) / words * 5, 2)
        row[_AT["capital"]] = b.text[:1].isupper()
        row[_AT["digits"]] = sum(map(str.isdigit, b.text)) / size if size < 200 else 0
        row[_AT["copyright"]] = words < 40 and bool(_LEGAL.search(b.text))
        spoiled = bool(b.kinds - {"content"}) or not _ASIDE.isdisjoint(b.inside)
        row[_AT["spoiled"]] = spoiled
        row[_AT["clean"]] = holds[i] and not spoiled
        row[_AT["bare"]] = not holds[i] and not spoiled
        row[_AT["outside"]] = not holds[i] and some
        row[_AT["pipes"]] = b.text.count("|") + b.text.count("·") + b.text.count("»") > 0
    return x


@dataclass
class Field:
    """A linear-chain CRF with two labels: 1 is content."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((len(NAMES), 2)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels, by Viterbi."""
        n = len(x)
        if not n:
            return np.zeros(0, dtype=np.int64)
        (a, b), scores = self.first.tolist(), (x @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = a + scores[0][0], b + scores[0][1]
        back = []
        for s0, s1 in scores[1:]:
            to0, to1 = b + m10 > a + m00, b + m11 > a + m01
            back.append((int(to0), int(to1)))
            a, b = (b + m10 if to0 else a + m00) + s0, (b + m11 if to1 else a + m01) + s1
        out = [int(b > a)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return np.array(out[::-1])

    @classmethod
    def fit(cls, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 160, ridge: float = 0.0005, rate: float = 0.12) -> Field:
        """Maximum likelihood with a ridge, by forward-backward sums over all pages at once and Adam."""
        pages = [p for p in pages if len(p[0])]
        most, n = max(len(x) for x, _ in pages), len(pages)
        x = np.zeros((n, most, len(NAMES)))
        y = np.zeros((n, most), dtype=np.int64)
        mask = np.zeros((n, most), dtype=bool)
        for k, (a, b) in enumerate(pages):
            x[k, : len(a)], y[k, : len(b)], mask[k, : len(a)] = a, b, True
        flat = x.reshape(-1, len(NAMES))
        hot = np.eye(2)[y] * mask[:, :, None]
        pair = mask[:, 1:] & mask[:, :-1]
        seen = np.einsum("nti,ntj->ij", hot[:, :-1] * pair[:, :, None], hot[:, 1:])
        out = cls()
        size = [out.emit.size, 4, 2]
        w = np.zeros(sum(size))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            emit, move, first = w[: size[0]].reshape(-1, 2), w[size[0] : -2].reshape(2, 2), w[-2:]
            s = (flat @ emit).reshape(n, most, 2)
            alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
            alpha[:, 0] = s[:, 0] + first
            for t in range(1, most):
                nxt = np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + s[:, t]
                alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
            for t in range(most - 2, -1, -1):
                after = s[:, t + 1] + beta[:, t + 1]
                nxt = np.stack([np.logaddexp(move[i, 0] + after[:, 0], move[i, 1] + after[:, 1]) for i in (0, 1)], axis=1)
                beta[:, t] = np.where(mask[:, t + 1, None], nxt, 0)
            total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p = np.exp(np.minimum(alpha + beta - total[:, None, None], 0)) * mask[:, :, None]
            joint = alpha[:, :-1, :, None] + move + (s + beta)[:, 1:, None, :] - total[:, None, None, None]
            want = (np.exp(np.minimum(joint, 0)) * pair[:, :, None, None]).sum(axis=(0, 1))
            g = np.concatenate([(flat.T @ (hot - p).reshape(-1, 2)).reshape(-1), (seen - want).reshape(-1), (hot - p)[:, 0].sum(axis=0)]) / n - ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(w[: size[0]].reshape(-1, 2).copy(), w[size[0] : -2].reshape(2, 2).copy(), w[-2:].copy())


def labelled_pages(n: int = 500, seed: int = 11) -> list[list[tuple[str, str, bool]]]:
    """Pages of labelled parts (html, text, is_content) in many layouts, for training: a seeded page writer.

    Articles stand in article, main, section or div, with tables, lists, quotes and code; around and between them come
    menus, banners, notices, adverts, sidebars, share bars, forms, reader comments and footers, under usual names or under none.
    """
    rng = np.random.Generator(np.random.PCG64(seed))

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def word() -> str:
        return "".join(pick(("an", "er", "th", "re", "on", "in", "st", "ou", "é", "ü", "la", "de", "ti", "sch", "ción", "ho")) for _ in range(int(rng.integers(1, 5))))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(a, b))))

    def sentences(k: int) -> str:
        out = []
        for _ in range(k):
            s = words(3, 18)
            out.append(s[:1].upper() + s[1:] + pick((".", ".", ".", "!", "?")))
        return " ".join(out)

    def inline(text: str) -> str:
        parts = text.split(" ")
        k = int(rng.integers(len(parts)))
        if rng.random() < 0.3:
            parts[k] = pick(("<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<code>{}</code>", "<span class=hl>{}</span>")).format(parts[k])
        return " ".join(parts)

    def wrap(tag: str, names: tuple[str, ...], bare: float) -> tuple[str, str]:
        if rng.random() < bare:
            return f"<{tag}>", f"</{tag}>"
        attr = pick(("class", "class", "id"))
        name = pick(names)
        if rng.random() < 0.3:
            name = f"{pick(('site', 'page', 'js', 'c', 'block'))}-{name}"
        return f'<{tag} {attr}="{name}">', f"</{tag}>"

    Part = tuple[str, str, bool]

    def boilerplate(kind: str) -> list[Part]:
        rows: list[str] = []
        if kind == "menu":
            tag, names = pick(("nav", "nav", "div", "ul")), ("menu", "nav", "navigation", "breadcrumbs", "navbar")
            rows = [f"<li><a href='/{k}'>{words(1, 3)}</a></li>" for k in range(int(rng.integers(2, 9)))]
            bare = 0.8 if tag == "nav" else 0.0
        elif kind == "header":
            tag, names, bare = pick(("header", "header", "div")), ("header", "masthead", "topbar", "logo"), 0.6
            rows = [f"<{t}>{words(1, 8)}</{t}>" for t in (pick(("div", "p", "span", "h1", "h2")),) * int(rng.integers(1, 3))]
            bare = 0.8 if tag == "header" else 0.0
        elif kind == "footer":
            tag, names = pick(("footer", "footer", "div")), ("footer", "copyright", "legal", "bottom")
            rows = [pick((f"&copy; {words(1, 5)} &middot; {sentences(1)}", f"<p>{sentences(1)}</p>", f"<p>Copyright 2024 {words(1, 4)}. All rights reserved.</p>", f"<a href=/i>{words(1, 2)}</a> | <a href=/j>{words(1, 2)}</a>")) for _ in range(int(rng.integers(1, 3)))]
            bare = 0.8 if tag == "footer" else 0.0
        elif kind == "ad":
            tag, names, bare = pick(("div", "div", "aside", "section", "p")), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"), 0.0
            rows = [pick(("{}", "<p>{}</p>", "<a href='//ad'>{}</a>")).format(sentences(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(1, 3)))]
        elif kind == "side":
            tag, names = pick(("aside", "aside", "div", "section")), ("sidebar", "related", "widget", "recommended", "popular", "trending")
            rows = [f"<h3>{words(1, 4)}</h3>"] + [pick((f"<li><a href='/r{k}'>{words(3, 9)}</a></li>", f"<p>{sentences(int(rng.integers(1, 4)))}</p>")) for k in range(int(rng.integers(1, 5)))]
            bare = 0.6 if tag == "aside" else 0.0
        elif kind == "notice":
            tag, names, bare = pick(("div", "div", "section", "p", "dialog")), ("cookie-notice", "notice", "consent", "alert", "popup", "gdpr-banner", "paywall", "announcement"), 0.0
            rows = [pick((f"<p>{sentences(int(rng.integers(1, 4)))}</p>", f"{sentences(2)} <button>{words(1, 2)}</button>", f"This site uses cookies. {sentences(1)}"))]
        elif kind == "form":
            tag, names, bare = "form", ("search", "newsletter", "login", "subscribe", "contact-form"), 0.7
            rows = [pick((f"<label>{words(1, 5)}</label><input name=q>", f"<p>{sentences(1)}</p><button>{words(1, 2)}</button>", f"<select><option>{words(1, 2)}<option>{words(1, 2)}</select>")) for _ in range(int(rng.integers(1, 4)))]
        elif kind == "comment":
            tag, names, bare = pick(("section", "div", "ol", "div")), ("comments", "comment-list", "disqus_thread", "reader-comments", "replies", "discussion"), 0.0
            inner = pick(("div class=comment", "li", "article class='comment'", "p"))
            rows = [f"<{inner}>{pick(('', f'<b>{word()}</b>: '))}{sentences(int(rng.integers(1, 6)))}</{inner.split()[0]}>" for _ in range(int(rng.integers(1, 6)))]
        else:
            tag, names, bare = "div", ("share", "social", "follow-us", "byline", "meta", "tags"), 0.0
            rows = [f"<a href=/s>{words(1, 3)}</a>" for _ in range(int(rng.integers(1, 5)))]
        start, end = wrap(tag, names, bare)
        return [(start, "", False), *[(r, "", False) for r in rows], (end, "", False)]

    def article() -> list[Part]:
        parts: list[Part] = []
        if rng.random() < 0.85:
            parts.append((f"<h1>{words(1, 12)}</h1>", "", True))
        for _ in range(int(rng.integers(1, 10))):
            text = sentences(int(rng.choice([0, 1, 2, 4, 8, 14]))) or words(1, 3)
            shape = rng.random()
            if shape < 0.62:
                parts.append((f"<p>{inline(text)}" + pick(("</p>", "</p>", "")), "", True))
            elif shape < 0.70:
                parts.append((f"<p><b>{text}<br>", "", True))
            elif shape < 0.77:
                parts.append((f"<h2>{words(1, 7)}</h2>", "", True))
            elif shape < 0.84:
                parts += [("<ul>", "", True), *[(f"<li>{inline(sentences(1) if rng.random() < 0.6 else words(1, 6))}</li>", "", True) for _ in range(int(rng.integers(2, 5)))], ("</ul>", "", True)]
            elif shape < 0.89:
                parts.append((f"<blockquote>{text}</blockquote>", "", True))
            elif shape < 0.93:
                parts.append((f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 6)}</td></tr></table>", "", True))
            elif shape < 0.96:
                parts.append((f"<pre>{words(3, 12)}</pre>", "", True))
            else:
                parts.append((pick((f"<div>{text}</div>", f"{text}<br>{text}", f"{text}")), "", True))
            if rng.random() < 0.08:
                parts += boilerplate(pick(("ad", "share", "side", "notice", "form")))
        return parts

    out = []
    for _ in range(n):
        page: list[Part] = [] if rng.random() < 0.08 else [(f"<html><head><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>", "", False)]
        for kind, chance in (("notice", 0.25), ("header", 0.45), ("menu", 0.8), ("ad", 0.5), ("form", 0.15), ("side", 0.15)):
            if rng.random() < chance:
                page += boilerplate(kind)
        holder = rng.random()
        if holder < 0.5:
            start, end = pick((("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<article class="post">', "</article>")))
        elif holder < 0.84:
            start, end = wrap(pick(("div", "section", "div")), ("content", "article-body", "post", "entry-content", "story", "main"), 0.0)
        elif holder < 0.9:
            start, end = "<div>", "</div>"
        else:
            start, end = "", ""
        page += [(start, "", True), *article(), (end, "", True)]
        for kind, chance in (("share", 0.25), ("comment", 0.4), ("side", 0.4), ("form", 0.2), ("ad", 0.25), ("menu", 0.15), ("notice", 0.15), ("footer", 0.85)):
            if rng.random() < chance:
                page += boilerplate(kind)
        out.append(page)
    return out


def examples(pages: list[list[tuple[str, str, bool]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of labelled pages: each part's text carries its label into the parsed page."""
    out = []
    for page in pages:
        # Private-use marks around the text of content parts survive parsing and tell each block's label.
        marked = "".join(_mark(h) if inside else h for h, _, inside in page)
        found = blocks(marked)
        labels = np.array([int("\ue000" in b.text) for b in found], dtype=np.int64)
        for b in found:
            b.text = b.text.replace("\ue000", "").strip() or "x"
        out.append((features(found), labels))
    return out


def _mark(part: str) -> str:
    return re.sub(r">([^<\s][^<]*)|^([^<\s][^<]*)", lambda m: m.group(0) + "\ue000", part)


_trained: list[Field] = []


def trained() -> Field:
    """The field fitted to ``labelled_pages``: the same weights in every process."""
    if not _trained:
        _trained.append(Field.fit(examples(labelled_pages())))
    return _trained[0]


def main_text(page: str | None, crf: Field) -> str:
    """The content blocks of one page joined by newlines; empty for a null, empty or text-free page."""
    found = blocks(page or "")
    if not found:
        return ""
    labels = crf.decode(features(found))
    return "\n".join(b.text for b, keep in zip(found, labels.tolist()) if keep)


def extract(pages: DataFrame, crf: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row (page_id, url, html). The weights are a few hundred numbers."""
    ship(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(crf or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [main_text(h, held.value) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``. Null, empty and text-free pages give an empty text, repeated rows each a row, an empty table none."""
    return extract(table(spark, sf_dir, "pages"))
