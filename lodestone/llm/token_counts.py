"""Token counts of whole texts, however long, as a tokenizer library gives them.

A huge document is cut into chunks that overlap. Each chunk is encoded by
itself, anywhere, with offsets; neighbours are spliced where both begin a
pre-token at the same place of their overlap. Where an overlap has no such
place, the document's chunks and overlaps are widened and it is encoded again,
at last in one piece.

Why a splice is right: a byte-level tokenizer cuts a text into pre-tokens from
left to right and merges within each alone, so what follows the start of a
pre-token depends on nothing before it. A chunk that begins at such a start
finds the true ones, except near its end, where it doesn't see what follows; a
pre-token's end depends on no more than LOOKAHEAD characters and the longest
special string behind it, and starts so near to the end don't count. So by
induction the places that two chunks share are true ones, and what lies
between two of them is counted from the chunk that holds both.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import staged, table, unstage

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
HUGE = 16_384  # characters; longer documents are cut
CHUNK = 8_192
OVERLAP = 256
WIDEN = 8
LOOKAHEAD = 4
KNOWN = 400_000  # pre-tokens whose counts a task remembers
TOGETHER = 256  # texts, or chunks, that are encoded in one call
VERIFIED = 0x3000  # code points up to here may be cut by PRE_TOKEN, if it cuts them as the library does

# Fixed value: how byte-level tokenizers of this kind cut a text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def margin(path: str) -> int | None:
    """How many characters before a chunk's end its pre-tokens may still be
    wrong; null if nothing is proven for this tokenizer, whose texts are then
    encoded whole: one with a normalizer, another pre-tokenizer, random merges
    or special strings that also take what is around them."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model, added = spec.get("pre_tokenizer") or {}, spec.get("model") or {}, spec.get("added_tokens") or []
    plain = all(not t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    whole = spec.get("normalizer") is None and spec.get("post_processor") is None and spec.get("truncation") is None and spec.get("padding") is None
    if not (plain and byte_level and whole and model.get("type") == "BPE" and not model.get("dropout")):
        return None
    return LOOKAHEAD + max((len(t["content"]) for t in added), default=0)


class Tokens:
    """A tokenizer file's library and the counts of pre-tokens it has seen."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        self.specials = self.cut = None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            if margin(path) is not None:
                self.cut = regex.compile(PRE_TOKEN)
                self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
                self.odd = regex.compile(self._unverified())
                self.letters = {b: self.library.pre_tokenizer.pre_tokenize_str(chr(b))[0][0][-1] for b in range(128)} | self._upper_half()
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encoded_lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]

    def encoded_lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _upper_half(self) -> dict[int, str]:
        """The letters that stand for bytes beyond ASCII, read from characters that hold them."""
        found = {}
        for c in map(chr, [*range(0x80, 0x800), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x8000)]):
            if not "\ud800" <= c <= "\udfff":
                shown = "".join(x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(c))
                found.update(zip(c.encode(), shown, strict=True))
        return found

    def _unverified(self) -> str:
        """A pattern of the characters that the library may cut otherwise."""
        wrong = []
        for c in map(chr, range(VERIFIED)):
            text = f"a{c}{c}1 {c}\n{c}'{c}  {c}"
            if self.cut.findall(text) != [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]:
                wrong.append(regex.escape(c))
        return rf"[^\x00-\u{VERIFIED - 1:04x}{'' if not wrong else ']|[' + ''.join(wrong)}]"

    def _parts(self, texts: list[str]) -> list[list[str] | None]:
        """The pre-tokens of each text, whose counts are then known; null for
        texts with special strings or unverified characters."""
        if len(self.known) > KNOWN:
            self.known.clear()
        free = [not any(s in t for s in self.specials) and (t.isascii() or not self.odd.search(t)) for t in texts]
        parts = [self.cut.findall(t) if f else None for t, f in zip(texts, free, strict=True)]
        merged, letters = self.library.model.tokenize, self.letters
        for p in set().union(*(p for p in parts if p is not None)) - self.known.keys():
            self.known[p] = len(merged(p.encode().decode("latin-1").translate(letters)))
        return parts

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts. Pre-tokens are encoded once each; texts that
        can't be cut here go to the library whole."""
        if self.cut is None:
            return self.encoded_lengths(texts)
        parts = self._parts(texts)
        whole = iter(self.encoded_lengths([t for t, p in zip(texts, parts, strict=True) if p is None]))
        return [next(whole) if p is None else sum(map(self.known.__getitem__, p)) for p in parts]

    def starts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Of each text where its pre-tokens start, how many tokens lie before
        each start, and how many there are."""
        for text, parts in zip(texts, self._parts(texts), strict=True):
            if parts is not None:
                places = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
                before = np.cumsum(np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts)))
                yield np.r_[0, places[:-1]], np.r_[0, before[:-1]], int(before[-1])
                continue
            e = self.library.encode(text, add_special_tokens=False)
            words = np.array(e.word_ids, dtype=np.int64)
            first = np.flatnonzero(np.diff(words, prepend=-1))
            yield np.array([a for a, _ in e.offsets], dtype=np.int64)[first], first, len(words)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    """Kept in a Python worker for its next tasks, with the pre-tokens it knows."""
    return Tokens(path)


CHUNK_ROW = "row long, doc_id {id}, n_bytes long, chunk long, start long, last boolean, text string"
SUMMARY = "row long, doc_id {id}, n_bytes long, chunk long, last boolean, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>, n long"


def _chunks(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Rows of chunks; a text is cut as a stream, some chunks at a time."""
    kind = huge.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                text = one.column("text")[0].as_py()
                starts = range(0, max(1, len(text) - overlap), chunk)  # only the last chunk reaches the end, which is beyond its overlap
                for k in range(0, len(starts), TOGETHER):
                    own = starts[k : k + TOGETHER]
                    repeat = lambda c: pa.concat_arrays([one.column(c)] * len(own))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [*map(repeat, ("row", "doc_id", "n_bytes")), pa.array(range(k, k + len(own)), pa.int64()), pa.array(own, pa.int64()), pa.array([s + chunk + overlap >= len(text) for s in own]), pa.array([text[s : s + chunk + overlap] for s in own], pa.string())],
                        ["row", "doc_id", "n_bytes", "chunk", "start", "last", "text"],
                    )

    return huge.select("row", "doc_id", "n_bytes", "text").mapInArrow(cut, CHUNK_ROW.format(id=kind))


def _summaries(chunks: DataFrame, path: str, chunk: int, overlap: int, end_margin: int) -> DataFrame:
    """Of each chunk the pre-token starts in the overlaps with its neighbours."""
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                texts, begins = part.column("text").to_pylist(), part.column("start").to_pylist()
                lists: list[list] = [[] for _ in range(5)]
                for text, begin, (places, before, n) in zip(texts, begins, tokens.starts(texts), strict=True):
                    left = places <= overlap
                    right = (places >= chunk) & (places <= len(text) - end_margin)
                    for out, value in zip(lists, ((places[left] + begin).tolist(), before[left].tolist(), (places[right] + begin).tolist(), before[right].tolist(), n), strict=True):
                        out.append(value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "n_bytes", "chunk", "last")), *(pa.array(x, pa.list_(pa.int64())) for x in lists[:4]), pa.array(lists[4], pa.int64())], ["row", "doc_id", "n_bytes", "chunk", "last", "left_at", "left_n", "right_at", "right_n", "n"])

    return chunks.mapInArrow(summed, SUMMARY.format(id=kind))


def _spliced(summaries: DataFrame) -> DataFrame:
    """(row, doc_id, n_bytes, n_tokens), n_tokens null where two neighbours share no start."""
    over = "OVER (PARTITION BY row ORDER BY chunk)"
    shared = summaries.withColumn("from_at", F.expr(f"array_min(array_intersect(lag(right_at) {over}, left_at))")).withColumn("to_at", F.expr(f"array_min(array_intersect(right_at, lead(left_at) {over}))"))
    before = F.when(F.col("chunk") == 0, 0).otherwise(F.expr("left_n[int(array_position(left_at, from_at)) - 1]"))
    until = F.when(F.col("last"), F.col("n")).otherwise(F.expr("right_n[int(array_position(right_at, to_at)) - 1]"))
    parts = shared.select("row", "doc_id", "n_bytes", (until - before).alias("part"))
    whole = F.count("part") == F.count("*")
    return parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.when(whole, F.sum("part")).alias("n_tokens"))


def huge_counts(huge: DataFrame, path: str, end_margin: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of (row, doc_id, n_bytes, text), whatever
    the length of its texts. Each round encodes what the one before could not
    splice in chunks WIDEN times as wide, until a chunk holds a whole text, so
    a text is read as often as the logarithm of its longest pre-token says."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be more than 0 and fit into a chunk")
    done = None
    while True:
        summaries = _summaries(_chunks(huge, chunk, overlap).repartition("row", "chunk"), path, chunk, overlap, end_margin)
        found = staged(_spliced(summaries), "token-counts")
        spliced = found.filter("n_tokens IS NOT NULL").drop("row")
        done = spliced if done is None else done.unionByName(spliced)
        left = found.filter("n_tokens IS NULL").select("row")
        if left.isEmpty():
            return done
        huge = huge.join(left, "row", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    n_tokens is what the library of the tokenizer file (.json or .model) gives
    for the whole text without special tokens around it; special strings inside
    are read as the library does. Texts of more than `huge` characters are
    encoded in chunks where that is proven to give the same; else whole.

    Defined cases: null and empty texts have no bytes and no tokens; a text
    without any place to cut is encoded in one piece at last; rows that repeat
    an id, and null ids, keep their rows; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    end_margin = margin(path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in batches:
            n = []
            for at in range(0, batch.num_rows, TOGETHER):
                n += tokens.counts(batch.column("text").slice(at, TOGETHER).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    long_text = F.length("text") > huge
    plain = rows if end_margin is None else rows.filter(~long_text)
    found = plain.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    if end_margin is not None:
        own = staged(rows.filter(long_text).withColumn("row", F.monotonically_increasing_id()), "huge-texts")
        found = found.unionByName(huge_counts(own, path, end_margin, chunk, overlap))
        unstage(own)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
