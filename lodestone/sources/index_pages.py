"""Index pages: names in lists under running headings."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.tables import distinct_first

VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Index(HTMLParser):
    """Walks a page once. A heading counts until the next one, over whatever is
    nested between; what an item of a numbered list calls `strong` is the
    category of all links in it."""

    def __init__(self, prefix: str, lists: tuple[str, ...], within: str):
        super().__init__(convert_charrefs=True)
        self.prefix, self.lists, self.within = prefix, lists, within
        self.open: list[tuple[str, bool]] = []  # tags, and whether one begins the content
        self.inside = not within
        self.text: list[str] | None = None
        self.major, self.item, self.rows = "", None, []

    def _lists(self) -> list[str]:
        return [t for t, _ in self.open if t in ("ol", "ul")]

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in VOID_TAGS:
            return
        begins = not self.inside and found.get("id") == self.within
        self.inside = self.inside or begins
        if tag == "li":
            self._close_item_of_same_list()
        self.open.append((tag, begins))
        if not self.inside:
            return
        if tag == "li" and self._lists()[:1] == ["ol"] and len(self._lists()) == 1:
            self.item = {"category": None, "links": []}
        if tag == "h2" or (tag == "strong" and self.item and self.item["category"] is None) or (tag == "a" and self._is_entry(found)):
            self.text, self.reads, self.href = [], tag, found.get("href")

    def _is_entry(self, found: dict) -> bool:
        tags = [t for t, _ in self.open]
        return (found.get("href") or "").startswith(self.prefix) and "li" in tags and self._lists()[:1] != [] and self._lists()[0] in self.lists

    def _close_item_of_same_list(self):
        for tag, _ in reversed(self.open):
            if tag in ("ol", "ul"):
                return
            if tag == "li":
                self.handle_endtag("li")
                return

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            closed, begins = self.open.pop()
            if self.text is not None and closed == self.reads:
                self._take("".join(t.strip() for t in self.text))
            if closed == "li" and self.item and not self._lists()[1:] and [t for t, _ in self.open if t == "li"] == []:
                self._end_item()
            if begins:
                self.inside = False
            if closed == tag:
                return

    def _take(self, said: str):
        if self.reads == "h2":
            self.major = said
        elif self.reads == "strong":
            self.item["category"] = said
        elif said:
            (self.item["links"] if self.item else self.rows).append((self.major, "", said, self.href))
        self.text = None

    def _end_item(self):
        self.rows += [(major, self.item["category"] or "", name, href) for major, _, name, href in self.item["links"]]
        self.item = None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def finish(self) -> list[tuple[str, str, str, str]]:
        self.close()
        if self.item:
            self._end_item()
        return self.rows


def index_entries(pages: DataFrame, prefix: str = "/wiki/", lists: tuple[str, ...] = ("ol", "ul"), within: str = "content") -> DataFrame:
    """(page_id, place, major, category, name, href) of the links of all lists
    below the element `within` of each page (page_id, html), in page order:
    major is the heading before a list, category what its numbered item calls
    strong. Names without text are left out; null and broken pages give what
    can be read. Only outermost lists of the kinds `lists` count."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                index = _Index(prefix, lists, within)
                index.feed(html or "")
                out += [(page, place, *row) for place, row in enumerate(index.finish())]
            yield pd.DataFrame(out, columns=["page_id", "place", "major", "category", "name", "href"])

    return pages.select("page_id", "html").mapInPandas(read, f"page_id {kind}, place long, major string, category string, name string, href string")


def first_entries(entries: DataFrame) -> DataFrame:
    """Each name once, where it comes first by page and place."""
    return distinct_first(entries.withColumn("at", F.struct("page_id", "place")), ["name"], "at").drop("at")
