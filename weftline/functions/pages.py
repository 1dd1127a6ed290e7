"""What a raw page holds: its kind, text, metadata, embedded data, and whether it needs a browser.

Signals that are patterns over the page's source are column expressions. Those that need the element tree share one
parse in an Arrow batch function; the parser takes any input, closed or not.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scalars import let, trim_u, value_text
from weftline.functions.urls import DOCUMENTS, UNFOLLOWED, join_url, same_host

#: Elements that text is read from, and elements and roles whose text is not.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th blockquote pre".split())
NOISE_TAGS = frozenset("nav footer header aside form".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary".split())
UNREAD_TAGS = frozenset("script style noscript iframe".split())
#: HTML's elements without an end, and those that an opening tag of the listed kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
#: Phrases of pages that turn a visitor away.
BLOCK_PHRASES = (
    "just a moment", "enable javascript and cookies", "checking your browser", "please verify you are a human", "ray id", "cf-browser-verification",
    "403 forbidden", "access denied", "captcha", "unusual traffic", "robot or human", "please wait", "ddos protection", "attention required",
    "awswafintegration", "awswaf.com", "window.gokuprops", "challenge.js", "challenge-container",
)
#: Marks that only pages built in the browser bear.
APP_MARKS = (
    r"window\.__NEXT_DATA__", r"window\.__NUXT__", r"window\.__INITIAL_STATE__", r"window\.__REDUX_STATE__",
    r"window\.__APOLLO_STATE__|window\.__RELAY_STORE__|window\.__PRELOADED_STATE__", r"data-reactroot", r"data-v-[a-f0-9]+", r"(ng-version|data-ng-|_nghost-|_ngcontent-)",
)
APP_PATHS = r"(/_next/|/_nuxt/|/static/js/main\.|/static/js/[0-9]+\.)"
FRAMEWORKS = r"(?i)(ReactDOM|__vue__|angular\.min|next\.js|nuxt\.js|svelte|ember\.min|backbone\.min)"
BUNDLES = r"(?i)(webpack|chunk\.[a-f0-9]+\.js|bundle\.[a-f0-9]+\.js)"
ASKS_FOR_SCRIPTS = r"(?i)(enable javascript|javascript is required|javascript must be enabled)"
LEAKED_STYLES = r"\b(className|classList|css-[a-z0-9]+)\b"
COMMON_WORDS = ("the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "day", "get")
MOUNTS = ("root", "app", "__next", "__nuxt")
#: Where pages keep data for their scripts.
STATE_KEYS = (
    "window.__INITIAL_STATE__", "window.__NEXT_DATA__", "window.__NUXT__", "window.__NUXT_DATA__", "window.DATA", "window.__STATE__",
    "window.__REDUX_STATE__", "window.__PRELOADED_STATE__", "window.__APP_STATE__", "window.__DATA__",
)
ENDPOINTS = (
    r"""fetch\(['"]([^'"]+)['"]\)""", r"""axios\.(?:get|post|put)\(['"]([^'"]+)['"]\)""", r"""\.open\(['"](?:GET|POST)['"],\s*['"]([^'"]+)['"]\)""",
    r"""['"](/api/[^'"]+)['"]""", r"""['"](/v1/[^'"]+)['"]""", r"""['"](/v2/[^'"]+)['"]""", r"""['"](/graphql[^'"]*?)['"]""", r"""['"]([^'"]+\.json)['"]""",
)
CONTENT_KEYS = ('"articlebody"', '"text":', '"description":', '"headline":', '"content":', '"body":', '"name":', '"title":')
ITEM_KEYS = (*CONTENT_KEYS, '"job"', '"company"', '"salary"', '"location"', '"price"', '"product"', '"author"', '"date"')
GRAPHQL = ("__typename", "graphql", "apolloclient", "apollo-client", "urql")


# --- by the page's source alone --------------------------------------------------------------------------------


def content_type(c: Column) -> Column:
    """xml, json, text or html, by how the page begins."""
    t = trim_u(c)
    xml = t.startswith("<?xml") | t.startswith("<SEC-DOCUMENT") | t.startswith("<edgarSubmission")
    return F.when(xml, "xml").when(t.startswith("{") | t.startswith("["), "json").when(~t.contains("<"), "text").otherwise("html")


def _any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def soft_block(c: Column) -> Column:
    """Whether a short page says that the visitor is turned away."""
    return (F.octet_length(c) <= 15000) & let(F.lower(c), lambda low: _any(low, BLOCK_PHRASES))


def usable(c: Column) -> Column:
    """Whether the first 2000 bytes are mostly printable ASCII characters."""
    head = F.substring(F.encode(c, "UTF-8"), 1, 2000)
    printable = F.length(F.regexp_replace(head.cast("string"), r"[^\x20-\x7E\n\r\t]", ""))
    return (F.octet_length(c) >= 100) & (printable / F.octet_length(head) > 0.85)


def app_mark(c: Column) -> Column:
    """Whether the source bears a mark of a page built in the browser."""
    out = c.rlike(APP_MARKS[0])
    for p in APP_MARKS[1:]:
        out = out | c.rlike(p)
    return out


def useful_state(c: Column) -> Column:
    """Whether embedded data is content and not a list of scripts."""

    def content(low: Column) -> Column:
        scripts = trim_u(c).startswith("[") & _any(low, ("/_next/static/chunks/", ".js?dpl=", "webpack"))
        return ~scripts & _any(low, ITEM_KEYS)

    return (F.octet_length(c) >= 200) & let(F.lower(c), content)


def graphql(c: Column) -> Column:
    return let(F.lower(c), lambda low: _any(low, GRAPHQL))


# --- the element tree ------------------------------------------------------------------------------------------


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def text(self, unread: frozenset = frozenset()) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in unread:
                todo.extend(reversed(n.kids))
        return "".join(out)

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]


class _Builder(HTMLParser):
    """Builds the tree; ends what HTML leaves open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _end(self, tags: set[str], stop: set[str]) -> None:
        n = self.at
        while n.parent is not None and n.tag not in stop:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._end({"p"}, {"button", "table", "td", "th"})
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def page_lines(root: Node, base: str | None, links: bool) -> list[str]:
    """The page's text by element, 20 bytes and more, each once; links of documents (and others, if asked for), addresses and numbers."""
    out: list[str] = []
    seen: set[str] = set()

    def add(line: str, key: str) -> None:
        if key not in seen:
            seen.add(key)
            out.append(line)

    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        n, noisy = todo.pop()
        noisy = noisy or n.tag in NOISE_TAGS or n.attrs.get("role") in NOISE_ROLES
        if n.tag in TEXT_TAGS and not noisy:
            text = n.text(UNREAD_TAGS).strip()
            if len(text.encode()) >= 20 and text.lower() not in seen:
                add(text, text.lower())
                for a in n.find("a"):
                    to = join_url(base, a.attrs.get("href")) if "href" in a.attrs else ""
                    if to and (any(x in to.lower() for x in DOCUMENTS) or (links and re.sub(r"^(https?://)?(www\.)?", "", to).partition("/")[0] not in UNFOLLOWED)):
                        add(to, to)
        todo.extend((k, noisy) for k in reversed(n.kids) if isinstance(k, Node) and k.tag not in UNREAD_TAGS)
    for label, scheme in (("Email", "mailto:"), ("Phone", "tel:")):
        for a in root.find("a"):
            value = a.attrs.get("href", "")
            if value.startswith(scheme) and (rest := value[len(scheme) :].strip()):
                add(f"{label}: {rest}", f"{label}: {rest}".lower())
    return out


def metadata(root: Node) -> dict[str, str]:
    return {m.attrs[k]: m.attrs["content"] for m in root.find("meta") for k in ("name", "property") if m.attrs.get(k) and m.attrs.get("content")}


def title(root: Node) -> str:
    found = root.find("title")
    return found[0].text().strip() if found else ""


def alternate_url(root: Node) -> str:
    for m in root.find("meta"):
        if m.attrs.get("property") == "og:url":
            if m.attrs.get("content"):
                return m.attrs["content"]
            break
    for m in root.find("link"):
        if m.attrs.get("rel") == "canonical":
            return m.attrs.get("href", "")
    return ""


def wordpress(root: Node) -> bool:
    paths = [n.attrs.get(k, "") for n in root.find("script", "link") for k in ("src", "href")]
    return any("/wp-content/" in p or "/wp-includes/" in p for p in paths)


def confirmed_app(html: str, root: Node) -> bool:
    """Whether the page is surely built in the browser."""
    if any(re.search(p, html) for p in APP_MARKS):
        return True
    scripts = root.find("script")
    if any(re.search(APP_PATHS, s.attrs["src"]) for s in scripts if "src" in s.attrs):
        return True
    words = len(" ".join(b.text() for b in root.find("body")).split())
    if len(html.encode()) > 10 * 1024 and words < 50:
        return True
    return any(s.attrs.get("type") == "application/json" and len(s.text().encode()) > 500 for s in scripts)


def app_score(html: str, root: Node) -> tuple[int, bool]:
    """Points for needing a browser, and whether a strong sign is among them."""
    body = " ".join(b.text() for b in root.find("body")).strip()
    scripts = root.find("script")
    asks = sum(bool(re.search(ASKS_FOR_SCRIPTS, n.text())) for n in root.find("noscript"))
    mounts = sum(n.attrs.get("id") in MOUNTS and not n.text().strip() for n in root.find("div"))
    bundles = bool(re.search(BUNDLES, html))
    low, words = body.lower(), len(body.split())
    rare = len(body.encode()) > 50 and words > 0 and sum(low.count(f" {w} ") for w in COMMON_WORDS) / words < 0.05
    score = 2 * any(re.search(FRAMEWORKS, s.attrs["src"]) for s in scripts if "src" in s.attrs) + 2 * asks + 2 * mounts + (len(scripts) > 10) + bundles
    score += (len(body.encode()) < 300) + bool(re.search(LEAKED_STYLES, body, re.ASCII)) + (not root.find("p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "main")) + rare
    return int(score), bool(asks or mounts or bundles or rare)


def balanced(text: str, start: int) -> str:
    """From the bracket at start to the one that closes it, strings aside; empty if none does."""
    depth = 0
    for m in _BRACKETS.finditer(text, start):
        c = m.group()[0]
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return text[start : m.end()]
    return ""


_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*$|[{}\[\]]', re.S)


def is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def state(html: str, key: str) -> str:
    """The object or array that is assigned after key."""
    at = html.find(key)
    m = re.compile(r"[{\[]").search(html, at + len(key)) if at >= 0 else None
    return balanced(html, m.start()) if m else ""


def next_chunks(html: str) -> str:
    """The first JSON value in the joined chunks that a page pushes to its router."""
    joined = ""
    for m in re.finditer(r"self\.__next_f\.push\(\[(\d+),(.+?)\]\)", html):
        part = m.group(2).strip()
        try:
            value = json.loads(part)
        except ValueError:
            value = None
        joined += value if isinstance(value, str) else part
    for m in re.finditer(r"[{\[]", joined):
        for text in (joined[m.start() :], balanced(joined, m.start())):
            if text and is_json(text):
                return text
    return ""


def _has_item(s: str) -> bool:
    low = s.lower()
    scripts = s.strip().startswith("[") and any(x in low for x in ("/_next/static/chunks/", ".js?dpl=", "webpack"))
    return len(s.encode()) >= 200 and not scripts and any(k in low for k in ITEM_KEYS)


def _has_content(s: str) -> bool:
    low, size = s.lower().encode(), len(s.encode())  # lengths count bytes
    return is_json(s) and size >= 200 and any((at := low.find(k.encode())) >= 0 and size - at > 100 for k in CONTENT_KEYS)


def linked_data(root: Node) -> str:
    for s in root.find("script"):
        if s.attrs.get("type") == "application/ld+json" and _has_content(text := s.text().strip()):
            return text
    return ""


def embedded(html: str, root: Node) -> str:
    """The first embedded data that is content: states by key, router chunks, linked data."""
    for key in STATE_KEYS:
        found = state(html, key)
        if found and is_json(found) and _has_item(found):
            return found
    found = next_chunks(html)
    return found if found and _has_item(found) else linked_data(root)


def endpoints(html: str, base: str | None) -> list[str]:
    """Data addresses of the page's own host that its source names."""
    out: dict[str, None] = {}
    for p in ENDPOINTS:
        for m in re.finditer(p, html):
            to = join_url(base, m.group(1))
            if to.startswith(("http://", "https://")) and same_host(to, base or ""):
                out.setdefault(to)
    return list(out)


def xml_lines(text: str) -> str:
    """`name: value` for each text in an XML page, up to where it breaks."""
    out: list[str] = []
    stack: list[str] = []
    held: list[str] = []

    def flush() -> None:
        value = "".join(held).strip()
        held.clear()
        if value and value != "XXXXXXXX" and stack:
            out.append(f"{stack[-1]}: {value}")

    p = expat.ParserCreate()
    p.StartElementHandler = lambda name, _: (flush(), stack.append(name.rpartition(":")[2]))
    p.EndElementHandler = lambda _: (flush(), stack.pop())
    p.CharacterDataHandler = held.append
    try:
        p.Parse(text, True)
    except expat.ExpatError:
        flush()
    return "\n".join(out)


def json_lines(text: str) -> str:
    """`name: value` for each leaf of a JSON page, names joined by _, members of arrays numbered from 1."""
    try:
        value = json.loads(text, parse_int=float)
    except ValueError:
        return text.strip()
    out: list[str] = []
    numbers: dict[str, int] = {}

    def walk(name: str, v) -> None:
        if isinstance(v, dict):
            for k in sorted(v):
                walk(f"{name}_{k}" if name else k, v[k])
        elif isinstance(v, list):
            for x in v:
                numbers[name] = numbers.get(name, 0) + 1
                walk(f"{name}_{numbers[name]}", x)
        elif v is not None and (s := value_text(v).strip()):
            out.append(f"{name}: {s}")

    walk("", value)
    return "\n".join(out)


EXTRACTED = "title string, content string, metadata map<string,string>, alternate string, wordpress boolean, confirmed_app boolean, app_score int, app_anchor boolean, embedded string, endpoints array<string>"


def extracted(pages: DataFrame, url: str = "url", html: str = "html", links: bool = False) -> DataFrame:
    """pages with what each holds, in place of its source; one parse a page. Null sources hold nothing."""
    keep = [c for c in pages.columns if c != html]
    schema = T.StructType([*(pages.schema[c] for c in keep), *T._parse_datatype_string(EXTRACTED).fields])
    kind = content_type(F.col(html))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for base, source, k in zip(frame["_url"], frame["_html"], frame["_kind"], strict=True):
                source = source or ""
                if k in ("xml", "json", "text"):
                    content = xml_lines(source) if k == "xml" else json_lines(source) if k == "json" else source.strip()
                    rows.append(("", content, {}, "", False, False, 0, False, "", []))
                    continue
                root = parse(source)
                points, anchor = app_score(source, root)
                rows.append((title(root), "\n".join(page_lines(root, base, links)), metadata(root), alternate_url(root), wordpress(root), confirmed_app(source, root), points, anchor, embedded(source, root), endpoints(source, base)))
            made = pd.DataFrame(rows, columns=[f.name for f in schema.fields[len(keep) :]], index=frame.index)
            yield pd.concat([frame[keep], made], axis=1)

    return pages.select(*(F.col(c) for c in keep), F.col(url).alias("_url"), F.col(html).alias("_html"), kind.alias("_kind")).mapInPandas(run, schema)


