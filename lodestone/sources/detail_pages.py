"""Detail pages as nested sections, and the graph rows that rules read off them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN_TAGS = {"script", "style", "ins"}
CONTENT_TAGS = {"p", "ul", "ol", "table", "blockquote", "pre"}
NOISE = re.compile(r"[\d\s#]+")  # what templates leave behind
LINK_PREFIX = "/wiki/"

BLOCKS = "array<struct<tag:string,text:string,entities:array<string>>>"
SECTIONS = f"array<struct<heading:string,children:array<struct<heading:string,blocks:{BLOCKS}>>,blocks:{BLOCKS}>>"


class _Detail(HTMLParser):
    """Headings open sections (h1, h2) or their children (h3, h4); every other
    outermost content element is a block of the newest of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections: list[dict] = []
        self.hidden = self.depth = 0
        self.open, self.parts, self.link, self.links = None, [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif self.open == tag:
            self.depth += 1
        elif self.open is None and (tag in CONTENT_TAGS or re.fullmatch("h[1-4]", tag)):
            self.open, self.depth, self.parts, self.links = tag, 1, [], []
        elif tag == "a" and (dict(attrs).get("href") or "").startswith(LINK_PREFIX):
            self.link = []

    def handle_data(self, data):
        data = data.strip()
        if data and self.open and not self.hidden:
            self.parts.append(data)
            if self.link is not None:
                self.link.append(data)

    def handle_endtag(self, tag):
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.link is not None:
            self.links += ["".join(self.link)] if self.link else []
            self.link = None
        elif tag == self.open:
            self.depth -= 1
            if not self.depth:
                self.finish()

    def finish(self):
        tag, self.open, self.link = self.open, None, None
        if tag is None:
            return
        if tag[0] == "h":
            heading = {"heading": "".join(self.parts), "blocks": []}
            if tag in ("h1", "h2"):
                self.sections.append(heading | {"children": []})
            else:
                self.section()["children"].append(heading)
            return
        text = "\n".join(self.parts)
        if text and not NOISE.fullmatch(text):
            section = self.section()
            (section["children"] or [section])[-1]["blocks"].append({"tag": tag, "text": text, "entities": self.links})

    def section(self) -> dict:
        if not self.sections:
            self.sections.append({"heading": "", "children": [], "blocks": []})
        return self.sections[-1]


def parse_detail(html: str | None) -> list[dict]:
    page = _Detail()
    page.feed(html or "")
    page.close()
    page.finish()
    return page.sections


def detail_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, sections): null and empty pages have none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "sections": [parse_detail(h) for h in batch["html"]]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(parse, f"page_id long, sections {SECTIONS}")


def headed_blocks(found: Column) -> Column:
    """Every block with the heading right above it; children come first."""
    row = lambda heading, b: F.struct(heading.alias("heading"), b["text"].alias("text"), b["entities"].alias("entities"))
    inner = lambda s: F.flatten(F.transform(s["children"], lambda c: F.transform(c["blocks"], lambda b: row(c["heading"], b))))
    return F.flatten(F.transform(found, lambda s: F.concat(inner(s), F.transform(s["blocks"], lambda b: row(s["heading"], b)))))


def rule_edges(pages: DataFrame) -> DataFrame:
    """Edges (relation, subject, subject_type, object, object_type) of pages
    (name, type, meta, sections), repeats included: the class and subclass that
    meta names, the ingredients linked under a composition heading and the
    meridians linked under a meridian heading."""
    meta = F.filter(F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>"))), lambda e: e["value"] != "")
    kind = lambda e: F.when(F.contains(e["key"], F.lit("大类")), "Class").when(F.contains(e["key"], F.lit("分类")), "SubClass")
    classes = F.transform(F.filter(meta, lambda e: kind(e).isNotNull()), lambda e: F.struct(F.lit("BELONGS_TO").alias("relation"), F.col("type").alias("subject_type"), e["value"].alias("object"), kind(e).alias("object_type")))

    def linked(test, relation: str, subject_type: Column, object_type: str) -> Column:
        blocks = F.filter(headed_blocks(F.col("sections")), lambda b: test(b["heading"]))
        return F.transform(F.flatten(F.transform(blocks, lambda b: b["entities"])), lambda e: F.struct(F.lit(relation).alias("relation"), subject_type.alias("subject_type"), e.alias("object"), F.lit(object_type).alias("object_type")))

    has = lambda h, word: F.contains(h, F.lit(word))
    parts = linked(lambda h: has(h, "组成"), "HAS_INGREDIENT", F.lit("Formula"), "Herb")
    ways = linked(lambda h: has(h, "归经") | has(h, "经脉"), "HAS_MERIDIAN", F.col("type"), "Meridian")
    ways = F.filter(ways, lambda e: has(e["object"], "经"))
    return pages.select("name", F.explode(F.concat(classes, parts, ways)).alias("e")).select("e.relation", F.col("name").alias("subject"), "e.subject_type", "e.object", "e.object_type")


def rule_attributes(pages: DataFrame, tastes: list[str], natures: list[str]) -> DataFrame:
    """(name, type, taste, nature): dictionary characters under a property
    heading, in dictionary order; pages without any are left out."""
    blocks = F.filter(headed_blocks(F.col("sections")), lambda b: F.contains(b["heading"], F.lit("性味")))
    body = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
    found = lambda words: F.nullif(F.array_join(F.filter(F.lit(words), lambda w: F.contains(body, w)), "、"), F.lit(""))
    return pages.select("name", "type", found(tastes).alias("taste"), found(natures).alias("nature")).filter("taste IS NOT NULL OR nature IS NOT NULL")


def rule_entities(pages: DataFrame) -> DataFrame:
    """Distinct (name, type) of the pages and of all that their edges name."""
    edges = rule_edges(pages)
    return pages.select("name", "type").unionByName(edges.select(F.col("object").alias("name"), F.col("object_type").alias("type"))).distinct()
