"""Chapters within a byte budget, chunks of sections, and excerpts around needles."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.documents import pack_paragraphs, section_paths, sections

CHAPTER = re.compile(r"^##[ \t]+(?=\S)", re.MULTILINE)
BLANK_LINE = re.compile(r"\n\s*\n")


def size_of(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def byte_pieces(text: str, most: int) -> list[str]:
    """Runs of whole characters with `most` bytes or fewer; a character wider
    than that is a piece of its own."""
    ends = np.cumsum([size_of(c) for c in text])
    pieces, start, used = [], 0, 0
    while start < len(text):
        stop = max(start + 1, int(np.searchsorted(ends, used + most, side="right")))
        pieces.append(text[start:stop])
        start, used = stop, int(ends[stop - 1])
    return pieces


def _packed(body: str, most: int) -> Iterator[tuple[bool, str]]:
    """(cut, part): paragraphs together as far as they fit; longer ones are cut."""
    held, used = [], 0
    for paragraph in BLANK_LINE.split(body):
        size = size_of(paragraph)
        if held and used + 2 + size > most:
            yield False, "\n\n".join(held)
            held, used = [], 0
        if size > most:
            yield from ((True, piece) for piece in byte_pieces(paragraph, most))
        else:
            used += size + (2 if held else 0)
            held.append(paragraph)
    if held:
        yield False, "\n\n".join(held)


def chapter_parts(title: str, markdown: str | None, most: int) -> list[tuple[str, str]]:
    """(title, body) parts of `most` bytes or fewer. A text that fits is one
    part; else each `## ` chapter is, the text before the first one joined to
    it; else paragraphs are packed, and cut only where one alone is too long.
    Later parts of a chapter, and all that were cut, are numbered."""
    body = (markdown or "").strip()
    if size_of(body) <= most:
        return [(title, body)] if body else []
    starts = [m.start() for m in CHAPTER.finditer(body)]
    bounds = [0, *starts[1:], len(body)] if starts else [0, len(body)]
    out = []
    for n, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        piece = body[lo:hi].strip()
        name = body[starts[n] :].split("\n", 1)[0][2:].strip() if starts else title
        if size_of(piece) <= most:
            out.append((name, piece))
        else:
            out += [(name if k == 1 and not cut else f"{name}_{k}", part.strip()) for k, (cut, part) in enumerate(_packed(piece, most), 1)]
    return out


def split_chapters(docs: DataFrame, most: int, id_col: str = "doc_id", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, part, title, body), parts from 0; empty texts have none."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *part) for i, title, text in zip(batch["doc_id"], batch["title"], batch["text"], strict=True) for n, part in enumerate(chapter_parts(title or "", text, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "title", "body"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))
    return rows.mapInPandas(split, "doc_id long, part int, title string, body string")


def chunk_bodies(text: Column, size: int = 400, overlap: int = 80) -> Column:
    """Packed paragraphs; one longer than `size` goes on in windows."""
    return F.flatten(F.transform(pack_paragraphs(text, size), lambda c: F.when(F.length(c) > size, T.windows(c, size, overlap)).otherwise(F.array(c))))


def build_chunks(docs: DataFrame, size: int = 400, overlap: int = 80, preview: int = 240) -> DataFrame:
    """Index rows of documents (doc_id, doc_name, text): chunk_idx runs from 0
    over all sections of a document, parent_id names the section, and a chunk
    starts with its section's title unless it holds it."""
    found = section_paths(sections(T.clean_markdown(F.coalesce("text", F.lit("")))))
    parts = F.flatten(F.transform(found, lambda s: F.transform(chunk_bodies(s["body"], size, overlap), lambda c: F.struct(s["path"].alias("path"), c.alias("body"), F.substring(s["body"], 1, preview).alias("parent_text_preview")))))
    rows = docs.select("doc_id", "doc_name", F.posexplode(parts).alias("chunk_idx", "c"))
    title = F.element_at("c.path", -1)
    titled = F.when((title == "") | F.contains("c.body", title), F.col("c.body")).otherwise(F.concat(title, F.lit("\n"), "c.body"))
    rows = rows.select("doc_id", "doc_name", "chunk_idx", F.col("c.path").alias("section_path"), title.alias("parent_title"), titled.alias("text"), "c.parent_text_preview")
    parent = F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.substring(F.md5(F.array_join("section_path", " / ").cast("binary")), 1, 10))
    return rows.withColumns({"parent_id": parent, "text_simplified": T.to_simplified(F.col("text")), "text_traditional": T.to_traditional(F.col("text"))})


def covering_span(body: str, needles: list[str]) -> tuple[int, int] | None:
    """The shortest (start, end) that holds every needle: each place where one
    begins is tried as the start, with the next place of all the others."""
    places = [[m.start() for m in re.finditer(f"(?={re.escape(n)})", body)] for n in needles]
    best = None
    for start in sorted({p for found in places for p in found}):
        end = 0
        for found, needle in zip(places, needles, strict=True):
            at = bisect_left(found, start)
            if at == len(found):
                return best
            end = max(end, found[at] + len(needle))
        if best is None or end - start < best[1] - best[0]:
            best = start, end
    return best


def excerpt(body: str | None, needles: list[str], target: int = 1200, widest: int = 1600, snap: int = 200, least: int = 400, most: int = 1800) -> str | None:
    """About `target` characters around the shortest span of all needles, ends
    moved to line ends nearby. If that span is wider than `widest`, the nearest
    two needles do. Null if a needle is missing or the excerpt is too short."""
    body, needles = body or "", [n for n in dict.fromkeys(needles) if n]
    span = covering_span(body, needles) if needles else None
    if span is None:
        return None
    if span[1] - span[0] > widest and len(needles) > 1:
        pairs = [covering_span(body, [a, b]) for i, a in enumerate(needles) for b in needles[i + 1 :]]
        span = min(pairs, key=lambda s: (s[1] - s[0], s))
    pad = max(0, (target - (span[1] - span[0])) // 2)
    start, end = max(0, span[0] - pad), min(len(body), span[1] + pad)
    before, after = body.rfind("\n", 0, start + 1), body.find("\n", end)
    start = before + 1 if before >= 0 and start - before < snap else start
    end = after if 0 <= after < end + snap else end
    found = body[start:end].strip()
    if len(found) > most:
        cut = found.rfind("\n", 0, most)
        found = found[: cut if cut > most * 4 // 9 else most].strip()
    return found if len(found) >= least and any(n in found for n in needles) else None


def excerpt_column(text: Column, needles: list[str], target: int = 1200) -> Column:
    @F.pandas_udf("string")
    def excerpts(texts: pd.Series) -> pd.Series:
        return pd.Series([excerpt(t, needles, target) for t in texts], dtype="object")

    return excerpts(text)
