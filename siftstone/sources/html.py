"""Readable text of web pages, by a small tree over the standard library's tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button footer form header iframe nav noscript option script select style".split())
ROOTS = ({"main", "article"}, {"main", "content", "main-content", "article"}, {"main", "content", "main-content", "article", "post-content", "entry-content", "markdown-body", "document"})
NOISE = frozenset(
    "advert advertisement banner breadcrumb comment cookie footer header menu modal nav newsletter pagination popup recommended related share sidebar sidenav social subscribe topnav".split()
)
NOISY_IMAGE = tuple("/ad/ ads/ avatar badge button doubleclick favicon fullaccess icon logo pixel promo spacer sprite subscribe tracker tracking upgrade".split())
LEAST_CONTENT, LEAST_IMAGE = 200, 64


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def text(self) -> str:
        """Stripped texts below, with a space between them."""
        found: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                if at.strip():
                    found.append(at.strip())
            else:
                todo.extend(reversed(at.children))
        return " ".join(found)

    def all(self) -> Iterator[Node]:
        todo: list[Node | str] = [self]
        while todo:
            at = todo.pop()
            if isinstance(at, Node):
                yield at
                todo.extend(reversed(at.children))

    def noisy(self) -> bool:
        marks = " ".join(self.attrs.get(a, "") for a in ("id", "class", "role")).lower()
        return not NOISE.isdisjoint(re.split(r"[^a-z0-9]+", marks))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Node("")
        self.open = [self.top]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    """The page's tree without comments; unclosed elements end with those around them."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.top


def _prune(node: Node) -> None:
    for at in node.all():
        at.children = [c for c in at.children if isinstance(c, str) or c.name not in DROPPED]


def _content(top: Node) -> Node:
    """The largest content element of at least LEAST_CONTENT characters, else the body, else all."""
    best, size = None, LEAST_CONTENT - 1
    for node in top.all():
        marked = node.name in ROOTS[0] or node.attrs.get("role") == "main" or node.attrs.get("id") in ROOTS[1] or not ROOTS[2].isdisjoint(node.attrs.get("class", "").split())
        if marked and not node.noisy() and len(node.text()) > size:
            best, size = node, len(node.text())
    return best or next((n for n in top.all() if n.name == "body"), top)


def _srcset(value: str) -> str:
    parts = value.split(",")[-1].split()
    return parts[0] if parts else ""


def _wanted(url: str, caption: str, node: Node | None = None) -> bool:
    low = f"{url} {caption}".lower()
    if not url or ".svg" in low or any(x in low for x in NOISY_IMAGE):
        return False
    sides = [re.match(r"\d+", node.attrs.get(a, "")) for a in ("width", "height")] if node else []
    return not (len(sides) == 2 and all(sides) and all(int(s[0]) <= LEAST_IMAGE for s in sides))


def table_text(node: Node) -> str:
    """Rows with bars between non-empty cells, under the caption."""
    caption = next((n.text() for n in node.all() if n.name == "caption"), "")
    rows = []
    for row in (n for n in node.all() if n.name == "tr"):
        cells = [c.text() for c in row.all() if c.name in ("td", "th")]
        if any(cells):
            rows.append(" | ".join(c for c in cells if c))
    return "\n".join([f"Table: {caption}".rstrip() if caption else "Table:", *rows]) if rows else ""


def _walk(node: Node, base: str, out: list[str], seen: set[str]) -> None:
    todo = [iter(node.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            continue
        if isinstance(child, str):
            if child.strip():
                out.append(child.strip())
            continue
        if child.noisy():
            continue
        attrs = child.attrs
        if child.name == "img":
            raw = next((attrs[a].strip() for a in ("data-src", "data-original", "data-lazy-src", "src") if attrs.get(a, "").strip()), "") or _srcset(attrs.get("srcset", ""))
            url, caption = urljoin(base, raw) if raw else "", (attrs.get("alt") or attrs.get("title") or "").strip()
            if _wanted(url, caption, child) and url not in seen:
                seen.add(url)
                out.append(f"Image: {caption} ({url})" if caption else f"Image: {url}")
            continue
        if child.name == "source" and attrs.get("srcset"):
            url = urljoin(base, _srcset(attrs["srcset"]))
            if _wanted(url, "") and url not in seen:
                seen.add(url)
                out.append(f"Image source: {url}")
            continue
        if child.name == "video" and attrs.get("poster"):
            url = urljoin(base, attrs["poster"])
            if _wanted(url, "") and url not in seen:
                seen.add(url)
                out.append(f"Video poster: {url}")
        if child.name == "table":
            out.append(table_text(child))
            continue
        for raw in re.findall(r"url\(\s*['\"]?([^'\")]*)", attrs.get("style", "")):
            url = urljoin(base, raw.strip())
            if url and ".svg" not in url.lower():
                out.append(f"Background image: {url}")
        todo.append(iter(child.children))


def extract(html: str | None, base: str = "") -> tuple[str | None, str | None, str | None]:
    """(title, description, text) of a page; nulls for null."""
    if html is None:
        return None, None, None
    top = parse(html)
    title = next((n.text() for n in top.all() if n.name == "title"), "")
    metas = [n.attrs for n in top.all() if n.name == "meta"]
    description = next((m.get("content", "").strip() for key, value in (("name", "description"), ("property", "og:description")) for m in metas if m.get(key) == value), "")
    _prune(top)
    out = [f"Title: {title}"] * bool(title) + [f"Description: {description}"] * bool(description)
    _walk(_content(top), base, out, set())
    lines = (re.sub(r"\s+", " ", line).strip() for part in out for line in part.splitlines())
    return title, description, "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, keys: list[str], html_col: str = "html", url_col: str | None = None) -> DataFrame:
    """(keys, title, description, text) of each row; one Arrow pass, nothing is shuffled. A page that fails gets null text."""
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", title string, description string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for html, url in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                try:
                    found.append(extract(html, url or ""))
                except (AssertionError, ValueError):
                    found.append((None, None, None))
            columns = [pa.array(x, pa.string()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *columns], [*keys, "title", "description", "text"])

    url = F.col(url_col) if url_col else F.lit("")
    return pages.select(*keys, F.col(html_col).cast("string").alias("__html"), url.alias("__url")).mapInArrow(run, schema)
