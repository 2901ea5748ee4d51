"""Document sources and sinks: text files, web pages, JSON lists, chunk tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

# What a page's text leaves out, its root, and the blocks it keeps.
NOISE_SELECTORS = ["table.infobox", "table.navbox", ".mw-editsection", "#toc", ".toc", ".sister-projects", ".mw-empty-elt", "sup.reference", ".noprint", "style", "script", ".hatnote", ".ambox"]
ROOT_CLASS = "mw-parser-output"
BLOCK_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UPLOAD_SUFFIXES = [".md", ".txt", ".pdf"]
MAX_UPLOAD_BYTES = 8 << 20


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Text files below a folder: doc_id (the stem), doc_type (the folder's name)
    and text. Files of other kinds are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, r"([^/]+)\.\w+$", 1).alias("doc_id"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("doc_type"), F.col("value").alias("text"))


class _Blocks(HTMLParser):
    """Walks a page once with the stack of open elements. An element that a
    noise selector matches hides all until it is closed, and an end tag closes
    what is open within it, so pages with missing end tags hide no more than
    their own parents hold. A block within a block is text of the outer one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []  # tags, and what each began: noise, root, block or nothing
        self.hidden = self.blocks = self.roots = 0
        self.parts: list[str] = []
        self.rows: list[tuple[bool, str, str]] = []  # in the root, tag, text
        self.rooted = False

    @staticmethod
    def _is_noise(tag: str, found: dict) -> bool:
        classes = (found.get("class") or "").split()
        return any(s == tag or s == f"#{found.get('id')}" or any(s in (f".{c}", f"{tag}.{c}") for c in classes) for s in NOISE_SELECTORS)

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        found, begins = dict(attrs), ""
        if self._is_noise(tag, found):
            begins, self.hidden = "noise", self.hidden + 1
        elif not self.hidden and tag in BLOCK_TAGS:
            begins, self.blocks = "block", self.blocks + 1
        elif not self.rooted and ROOT_CLASS in (found.get("class") or "").split():
            begins, self.roots, self.rooted = "root", 1, True
        self.open.append((tag, begins))

    def handle_startendtag(self, tag, attrs):
        if tag not in VOID_TAGS:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, began = self.open.pop()
        if began == "noise":
            self.hidden -= 1
        elif began == "root":
            self.roots = 0
        elif began == "block":
            self.blocks -= 1
            if not self.blocks:
                if self.parts:
                    self.rows.append((bool(self.roots), tag, " ".join(self.parts)))
                self.parts = []
        return tag

    def handle_data(self, data):
        if self.blocks and not self.hidden and data.strip():
            self.parts.append(data.strip())

    def finish(self) -> list[tuple[str, str]]:
        self.close()
        while self.open:
            self._pop()
        return [(tag, text) for inside, tag, text in self.rows if inside or not self.rooted]


def html_to_markdown(html: str | None) -> str:
    """Headings, paragraphs, list items and quotes of a page, without its noise."""
    blocks = _Blocks()
    blocks.feed(html or "")
    lines: list[str] = []
    for tag, text in blocks.finish():
        if tag == "li":
            lines.append(f"- {text}")
        else:
            lines += [f"{'#' * int(tag[1])} {text}" if tag[0] == "h" else text, ""]
    return "\n".join(lines).strip()


def pages_to_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "markdown": [html_to_markdown(h) for h in batch["html"]]})

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInPandas(convert, "page_id long, markdown string")


def sections(text: Column) -> Column:
    """(level, title, body) of each heading; text before the first one is left
    out, and a text without headings is one section of level 0. Headings are
    marked by control characters; those of the text itself are dropped."""
    text = F.translate(text, "\u0001\u0002\u0003", "")
    marked = F.regexp_replace(text, r"(?m)^(#{1,6})\s+(.+?)\s*$", "\u0001$1\u0002$2\u0003")
    parts = F.slice(F.split(marked, "\u0001"), 2, F.size(F.split(marked, "\u0001")))
    found = F.transform(
        parts,
        lambda p: F.struct(
            F.length(F.substring_index(p, "\u0002", 1)).alias("level"),
            F.substring_index(F.substring_index(p, "\u0003", 1), "\u0002", -1).alias("title"),
            T.strip(F.substring_index(p, "\u0003", -1)).alias("body"),
        ),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("title"), T.strip(text).alias("body"))))


def section_paths(found: Column) -> Column:
    """Sections with the titles above them: a stack that drops what isn't higher.
    Empty sections are left out but stand on the stack."""
    start = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("stack"), F.array().cast("array<struct<path:array<string>,body:string>>").alias("out"))

    def step(state, s):
        stack = F.concat(F.filter(state["stack"], lambda h: h["level"] < s["level"]), F.array(F.struct(s["level"].alias("level"), s["title"].alias("title"))))
        row = F.struct(F.transform(stack, lambda h: h["title"]).alias("path"), s["body"].alias("body"))
        return F.struct(stack.alias("stack"), F.when(s["body"] != "", F.concat(state["out"], F.array(row))).otherwise(state["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda state: state["out"])


def pack_paragraphs(text: Column, size: int = 400) -> Column:
    """Blank-line paragraphs joined up to `size` characters. A longer paragraph
    stands alone; cut it with `windows`."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), T.strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(state, p):
        joined = F.when(state["held"] == "", p).otherwise(F.concat(state["held"], F.lit("\n\n"), p))
        fits = F.length(joined) <= size
        flushed = F.when(state["held"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["held"])))
        return F.struct(F.when(fits, state["done"]).otherwise(flushed).alias("done"), F.when(fits, joined).otherwise(p).alias("held"))

    return F.aggregate(parts, start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["held"])), lambda x: x != ""))


def upload_errors(name: Column, size: Column) -> Column:
    """What is wrong with an uploaded file; empty if nothing is."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    rules = {"unsafe_name": ~T.is_safe_name(name), "suffix": ~suffix.isin(UPLOAD_SUFFIXES), "empty": size <= 0, "too_large": size > MAX_UPLOAD_BYTES}
    return F.array_compact(F.array(*[F.when(test, error) for error, test in rules.items()]))


def whitelist(rows: DataFrame, sources: list[str], kinds: list[str], other: str = "其他") -> DataFrame:
    """Rows (id, source, kind) with an id and a known source; unknown kinds become `other`."""
    kept = rows.filter((F.trim(F.coalesce("id", F.lit(""))) != "") & F.col("source").isin(sources))
    return kept.withColumn("kind", F.when(F.col("kind").isin(kinds), F.col("kind")).otherwise(other))


def still_to_do(rows: DataFrame, *finished: DataFrame, key: str = "id") -> DataFrame:
    """What none of the finished tables holds, so a rerun goes on where it stopped."""
    for done in finished:
        rows = rows.join(done.select(key), key, "left_anti")
    return rows


def write_chunks(chunks: DataFrame, path: str, by: str = "doc_type") -> None:
    """Chunks as Parquet by type; only the types that come anew are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def first_heading(text: Column) -> Column:
    """The first `# ` line up to an opening bracket."""
    return F.trim(F.regexp_extract(text, r"(?m)^#\s+([^\n（(]*)", 1))



def front_matter(values: dict[str, Column]) -> Column:
    """A front-matter block with quoted values."""
    lines = [F.concat(F.lit(f"{k}: "), F.to_json(F.array(v.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(v.cast("string")))) - 2), F.lit("\n")) for k, v in values.items()]
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n"))
