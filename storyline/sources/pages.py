"""Text of web pages: elements without content dropped, the paragraphs of the main container kept.

The walk over a page's tree has no built-in equivalent; it runs in one Arrow batch
function, one page at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that go with all that they hold, phrases of boilerplate, classes of containers.
DROPPED = ["script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg", "button", "iframe"]
BOILERPLATE = [
    "cookie policy",
    "terms of service",
    "privacy policy",
    "all rights reserved",
    "subscribe to read",
    "sign up for newsletter",
    "advertisement",
]
CONTAINER_CLASS = r"article[-_]?(content|body)|story[-_]?content|post[-_]?content"
# Elements without an end, and those whose text isn't text of the page.
VOID = "area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split()
SILENT = ["template", "rt", "rp"]
LEAST_PARAGRAPH, MOST, LEAST_PAGE, SHORT = 25, 6000, 50, 250


class Node:
    """An element: its tag, its classes, and strings and elements in document order."""

    __slots__ = ("classes", "items", "tag")

    def __init__(self, tag: str, classes: str = ""):
        self.tag, self.classes, self.items = tag, classes, []

    def elements(self) -> Iterator[Node]:
        """The elements inside in document order, without dropped ones and what they hold."""
        waiting = list(reversed(self.items))
        while waiting:
            item = waiting.pop()
            if isinstance(item, Node) and item.tag not in DROPPED:
                yield item
                waiting.extend(reversed(item.items))

    def strings(self) -> Iterator[str]:
        """The texts inside in document order, stripped; empty ones are left out."""
        waiting = list(reversed(self.items))
        while waiting:
            item = waiting.pop()
            if isinstance(item, str):
                if item.strip():
                    yield item.strip()
            elif item.tag not in DROPPED and item.tag not in SILENT:
                waiting.extend(reversed(item.items))


class _Tree(HTMLParser):
    """Builds the tree.  An end tag closes all that was opened after its element; one without an open element is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open, self.counts, self.text = [self.root], Counter(), []

    def flush(self) -> None:
        if self.text:
            self.open[-1].items.append("".join(self.text))
            self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        node = Node(tag, dict(attrs).get("class") or "")
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        while self.counts[tag]:
            last = self.open.pop().tag
            self.counts[last] -= 1
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def tree(html: str) -> Node:
    page = _Tree()
    page.feed(html)
    page.close()
    page.flush()
    return page.root


def container(root: Node) -> Node:
    """The first article, else the first main, else the first element with a container's class, else the body, else the page."""
    first: dict[str, Node] = {}
    for node in root.elements():
        kind = node.tag if node.tag in ("article", "main", "body") else None
        if kind:
            first.setdefault(kind, node)
        if node.classes and "class" not in first and any(re.search(CONTAINER_CLASS, c, re.I) for c in [*node.classes.split(), " ".join(node.classes.split())]):
            first["class"] = node
        if "article" in first:
            break
    return next((first[k] for k in ("article", "main", "class", "body") if k in first), root)


def is_boilerplate(text: str) -> bool:
    low = text.lower()
    return any(phrase in low for phrase in BOILERPLATE)


def extract(html: str | None, most: int = MOST) -> str:
    """Text of a page: the container's paragraphs that are long enough and no boilerplate, else, if it has no paragraphs, all its text.

    A paragraph inside another's counts for both.  Text beyond ``most`` characters is cut at a blank.
    """
    if not html:
        return ""
    main, parts, held, paragraphs = container(tree(html)), [], 0, False
    for node in main.elements():
        if node.tag == "p":
            paragraphs = True
            text = " ".join(node.strings())
            if len(text) > LEAST_PARAGRAPH and not is_boilerplate(text):
                parts.append(text)
                held += len(re.sub(r"\s+", " ", text))
                if held > most:  # what comes later is cut anyway
                    break
    text = "\n\n".join(parts) if paragraphs else "\n".join(main.strings())
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    return text if len(text) <= most else text[:most].rsplit(" ", 1)[0] + "…"


def page_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(extract, na_action=None)

    return run(html)


def usable_text(rows: DataFrame, content: str = "content", summary: str = "summary", page: str = "page_text", excerpt: str = "excerpt", title: str = "title", html: bool = False) -> DataFrame:
    """Adds text, text_source and is_short: feed content, feed summary, page (50 characters at least), then excerpt or title.

    With ``html`` content and summary are markup of the feed, whose text is taken first.
    """
    if html:
        rows = rows.withColumns({"_content": page_text(F.col(content)), "_summary": page_text(F.col(summary))})
        return usable_text(rows, "_content", "_summary", page, excerpt, title).drop("_content", "_summary")
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    fetched = F.char_length(F.trim(F.coalesce(F.col(page), F.lit("")))) >= LEAST_PAGE
    text = F.when(has(content), F.col(content)).when(has(summary), F.col(summary)).when(fetched, F.col(page)).otherwise(F.trim(F.when(has(excerpt), F.col(excerpt)).otherwise(F.coalesce(F.col(title), F.lit("")))))
    kind = F.when(has(content), "rss_content").when(has(summary), "rss_summary").when(fetched, "page_extraction").otherwise("fallback")
    return rows.withColumns({"text": text, "text_source": kind, "is_short": F.char_length(text) < SHORT})
