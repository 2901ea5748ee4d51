"""SentencePiece encoding and decoding with N-best segmentations.

The lattice of a text has an edge for each vocabulary piece at each place. A
forward Viterbi pass scores every place; these scores are exact heuristics for
an A* search backward from the end, which yields segmentations in order of
their summed piece scores. No piece continues over the start of a word, so the
lattice falls into words: passes are kept by word, and the N best of a document
differ from its best one only in the words that lose least.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
N_BEST = 3
CACHE_BYTES = 64 << 20  # of a task's known words; they are forgotten and gathered anew beyond it
CACHED_LENGTH = 40
RANK_SHIFT = 100


def load_pieces(model_file: str = MODEL_FILE) -> list[tuple[str, float, str]]:
    """(piece, log probability, kind) by id; kind is normal, byte or other. A
    vocabulary is read once, by the driver, and has a fixed size.

    Scores of a unigram model are log probabilities. Those of a merge model are
    merge ranks, whose sums mean nothing on a lattice; nothing is trained here,
    so a rank r stands for the Zipf-Mandelbrot probability 1 / (r + RANK_SHIFT),
    scaled to sum to 1 over the pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"
    return log_probabilities([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())])


def log_probabilities(pieces: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """The pieces as they are if their scores are log probabilities, with
    log probabilities by rank if all scores are whole numbers, as merge ranks are."""
    normal = sorted((i for i, (_, _, kind) in enumerate(pieces) if kind == "normal"), key=lambda i: -pieces[i][1])
    if any(pieces[i][1] != round(pieces[i][1]) for i in normal):
        return pieces
    total = math.log(sum(1 / (r + RANK_SHIFT) for r in range(len(normal))))
    score = {i: -math.log(r + RANK_SHIFT) - total for r, i in enumerate(normal)}
    return [(piece, score.get(i, given), kind) for i, (piece, given, kind) in enumerate(pieces)]


class PieceLattice:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = next((i for i, (p, _, kind) in enumerate(pieces) if p == "<unk>"), 0)
        self.reach = {p: pieces[i][1] for p, i in self.ids.items()}  # of each piece its score
        self.root: dict[str, list] = {}  # by character: score (null if no piece ends here), id and next characters
        for p, i in self.ids.items():
            level, node = self.root, None
            for c in p:
                if level is None:
                    level = node[2] = {}
                node = level.get(c)
                if node is None:
                    node = level[c] = [None, -1, None]
                level = node[2]
            node[0], node[1] = pieces[i][1], i
        self.rare = min((pieces[i][1] for i in self.ids.values() if pieces[i][1] > -1e8), default=0.0) - 10.0
        self.shown = [self._shown(p, kind) for p, _, kind in pieces]
        words = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        lines = all("\n" not in p for p in self.ids)
        gap = "\n" if lines else ""
        pattern = f"{SPACE}*[^{SPACE}{gap}]+|{SPACE}+" + ("|\n" if lines else "")
        self.split = regex.compile(pattern).findall if words else lambda text: [text]
        self.plain = words and lines
        self.longest = max(map(len, self.ids), default=1)
        self.seen: dict[str, tuple[bytes, float, float]] = {}
        self.ways: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}
        self.held = 0  # bytes of both, about

    @staticmethod
    def _shown(piece: str, kind: str) -> str:
        if kind == "byte":
            value = int(piece[3:5], 16)
            return chr(value) if value < 128 else chr(0xDC00 + value)
        return piece if kind == "normal" else ""

    def edge_ids(self, piece: str) -> list[int]:
        """Ids of an edge: a piece, or a lone character as its UTF-8 bytes."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes.get(b, self.unknown) for b in piece.encode("utf-8", "surrogatepass")]

    def forward(self, word: str) -> tuple[list[float], list[float], list[int], list[int]]:
        """Best and second best score of every place, where the best path's
        last piece begins and its id, -1 for a character that no piece holds."""
        n, lost = len(word), float("-inf")
        best, second, back, last = [lost] * (n + 1), [lost] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        root, rare = self.root.get, self.rare
        for i, c in enumerate(word):
            b, s, j = best[i], second[i], i + 1
            score, piece, ahead = root(c) or (None, -1, None)
            if score is None:  # no piece is this character alone
                score = rare
            while True:
                if score is not None:
                    new, old = b + score, best[j]
                    if new > old:
                        best[j], back[j], last[j] = new, i, piece
                        second[j] = old if old > s + score else s + score
                    elif new > second[j]:
                        second[j] = new
                if ahead is None or j == n:
                    break
                node = ahead.get(word[j])
                if node is None:
                    break
                j += 1
                score, piece, ahead = node
        return best, second, back, last

    def best(self, word: str) -> tuple[bytes, float, float]:
        """Ids (as the bytes of an int32 array) and score of the best
        segmentation, and what the second loses."""
        if not word:
            return b"", 0.0, float("inf")
        best, second, back, last = self.forward(word)
        at, parts = len(word), []
        while at:
            if last[at] < 0:
                parts += self.edge_ids(word[back[at] : at])[::-1]
            else:
                parts.append(last[at])
            at = back[at]
        parts.reverse()
        found = array("i", parts).tobytes(), best[-1], best[-1] - second[-1]
        if len(word) <= CACHED_LENGTH:
            self._hold(350 + 6 * len(word))
            self.seen[word] = found
        return found

    def _hold(self, size: int) -> None:
        """Make room for so many bytes more."""
        self.held += size
        if self.held > CACHE_BYTES:
            self.seen.clear()
            self.ways.clear()
            self.held = size

    def words(self, text: str) -> list[str]:
        """The text with its leading space symbol, cut where no piece goes on."""
        if not self.plain or "  " in text or text[0] == " " or SPACE in text:
            return self.split(SPACE + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids): A* from the end of the word to its start.
        Of paths with equal estimates (nine digits) the one nearest to the start
        goes on, so a run of one character isn't searched in breadth."""
        best = self.forward(word)[0]
        order, found = count(), []
        scale = max(1.0, abs(best[-1])) * 1e-9
        heap = [(round(-best[-1] / scale), len(word), next(order), 0.0, None)]
        while heap and len(found) < n:
            _, at, _, tail, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    piece, path = path
                    ids += self.edge_ids(piece)
                found.append((tail, tuple(ids)))
                continue
            for i in range(max(0, at - self.longest), at):
                piece = word[i:at]
                score = self.reach.get(piece, self.rare if i == at - 1 else None)
                if score is not None and best[i] > float("-inf"):
                    heapq.heappush(heap, (round(-(best[i] + score + tail) / scale), i, next(order), score + tail, (piece, path)))
        return sorted(found, key=lambda x: -x[0])

    def encode(self, text: str | None, n: int = 1) -> tuple[bytes, list[float], list[list[tuple[int, tuple[int, ...]]]]]:
        """Ids of the best segmentation (as the bytes of an int32 array), the n
        best scores in falling order, and for each after the first its changed
        words as (word index, ids)."""
        parts, scores, changes = self.segmented(text, n)
        return b"".join(parts), scores, changes

    def segmented(self, text: str | None, n: int = 1) -> tuple[tuple[bytes, ...], list[float], list[list[tuple[int, tuple[int, ...]]]]]:
        """What `encode` gives, with the ids of each word apart."""
        if not text:
            return (), [], []
        words, get, best = self.words(text), self.seen.get, self.best
        parts, scores, losses = zip(*[get(w) or best(w) for w in words], strict=True)
        total = float(sum(scores))
        if n == 1:
            return parts, [total], []
        gaps = np.array(losses)
        near = np.argpartition(gaps, n - 2)[: n - 1] if len(gaps) > n - 1 else range(len(gaps))
        chosen: list[tuple[float, list[tuple[int, tuple[int, ...]]]]] = [(0.0, [])]
        for i in sorted(map(int, near)):
            if not words[i]:
                continue
            ways = self.ways.get((words[i], n))
            if ways is None:
                own = tuple(np.frombuffer(parts[i], dtype=np.int32).tolist())  # among equal sums the search may begin with another
                ways = [(scores[i], own), *(way for way in self.n_best(words[i], n) if way[1] != own)][:n]
                if len(words[i]) <= CACHED_LENGTH:
                    self._hold(400 + len(ways) * (150 + 8 * len(words[i])))
                    self.ways[(words[i], n)] = ways
            top = ways[0][0]
            chosen = heapq.nsmallest(n, ((loss + max(0.0, top - score), changed + ([(i, way)] if k else [])) for loss, changed in chosen for k, (score, way) in enumerate(ways)), key=lambda x: x[0])
        return parts, [total - loss for loss, _ in chosen], [changed for _, changed in chosen[1:]]

    def decode(self, ids) -> str:
        """The text of ids; each byte piece stands for its byte."""
        text = "".join(map(self.shown.__getitem__, ids))
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if not text.isascii() else text
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def normalised(text: str) -> str:
    """What decoding gives back: the space symbol itself reads as a space."""
    return text.replace(SPACE, " ")


CHANGES = "array<array<struct<first:int,length:int,ids:array<int>>>>"
CHANGES_TYPE = pa.list_(pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))
RESULT = f"ids array<int>, n_tokens long, score double, nbest_scores array<double>, nbest_changes {CHANGES}, round_trip boolean"


def _changed_runs(parts: tuple[bytes, ...], changes: list[list[tuple[int, tuple[int, ...]]]]) -> list[list[tuple[int, int, tuple[int, ...]]]]:
    """Changed words as (place of the first id replaced, how many, ids instead)."""
    return [[(len(b"".join(parts[:i])) // 4, len(parts[i]) // 4, ids) for i, ids in changed] for changed in changes]


def encode_documents(docs: DataFrame, pieces: list[tuple[str, float, str]], n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, score, nbest_scores,
    nbest_changes and round_trip, whether the ids decode to the text again.

    nbest_scores holds the `n_best` largest sums of piece scores over all
    segmentations of the whole text, fewer if there are fewer; nbest_changes says
    how each after the best differs from it: in place of the `length` ids from
    `first` on (0 is the first) it has others. `nbest_ids` writes them out. A
    character that no piece holds becomes its UTF-8 bytes.

    Defined cases: null and empty texts have no ids, score 0 and no
    alternatives; the space symbol U+2581 reads as a space; of equal sums the
    one whose last pieces begin first is best; ids of any type keep it;
    repeated rows and null ids keep their rows; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary: a fixed size

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids, ends, scores, best, changed, same = [], [0], [], [], [], []
                for text in part.column(1).to_pylist():
                    words, sums, changes = lattice.segmented(text, n_best)
                    own = b"".join(words)
                    ids.append(own)
                    ends.append(ends[-1] + len(own) // 4)
                    scores.append(sums[0] if sums else 0.0)
                    best.append(sums)
                    changed.append(_changed_runs(words, changes))
                    same.append(lattice.decode(np.frombuffer(own, dtype=np.int32).tolist()) == normalised(text or ""))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(scores, pa.float64()), pa.array(best, pa.list_(pa.float64())), pa.array(changed, CHANGES_TYPE), pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "n_tokens", "score", "nbest_scores", "nbest_changes", "round_trip"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def nbest_ids(ids: Column, changes: Column) -> Column:
    """The ids of the best segmentations, from the best one on; none of an empty text."""
    put = lambda at, c: F.concat(F.slice(at, F.lit(1), c["first"]), c["ids"], F.slice(at, c["first"] + c["length"] + 1, F.size(at)))
    others = F.transform(changes, lambda runs: F.aggregate(F.reverse(runs), ids, put))
    return F.when(F.size(ids) > 0, F.concat(F.array(ids), others)).otherwise(F.array().cast("array<array<int>>"))


def decode_documents(encoded: DataFrame, pieces: list[tuple[str, float, str]], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ids: doc_id and text; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(shared.value)
        for batch in batches:
            texts = [lattice.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(decoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), load_pieces())
