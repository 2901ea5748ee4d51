"""Words of texts that are written without spaces.

A run of letters becomes a graph with an edge for each dictionary word at each
place; the most probable path, found from its end by dynamic programming, gives
its words. A character at which no word begins stands alone. Runs of ASCII
letters and digits are words as they are.

Tasks hold the dictionary as a trie in arrays and look up all places of many
texts at once, so its words may be millions.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

TEXT_CHARACTERS = 1 << 22  # of the texts that are cut at once
RUN_CHARACTERS = 1 << 18  # of the runs that are walked together
FEW_RUNS = 8
LAST_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)  # so that no key is behind all others
RUN = r"[\p{L}\p{M}\p{N}]+"
RUN_BESIDE_ASCII = r"[A-Za-z0-9]+|[\p{L}\p{M}\p{N}--[A-Za-z0-9]]+"


class WordGraph:
    """Words with their counts; `ascii_words` keeps ASCII runs whole."""

    def __init__(self, counts: dict[str, int], ascii_words: bool = True):
        total = math.log(sum(counts.values()) or 1)
        self.score = {w: math.log(n) - total for w, n in counts.items() if w and n > 0}
        self.alone = -total  # of a character without a word: as if it had come once
        self.begins = {w[:i] for w in self.score for i in range(1, len(w))}
        self.ascii_words = ascii_words
        self.runs = regex.compile(RUN_BESIDE_ASCII if ascii_words else RUN, regex.V1)

    def path(self, run: str) -> list[str]:
        """The most probable words of a run; of equal paths the one whose first
        words are longer."""
        n = len(run)
        best, end = [0.0] * (n + 1), list(range(1, n + 2))
        for i in range(n - 1, -1, -1):
            top, at, j = None, i + 1, i + 1
            while True:
                word = run[i:j]
                if word in self.score and (top is None or self.score[word] + best[j] >= top):
                    top, at = self.score[word] + best[j], j
                if j >= n or word not in self.begins:
                    break
                j += 1
            best[i], end[i] = (self.alone + best[i + 1], i + 1) if top is None else (top, at)
        out, i = [], 0
        while i < n:
            out.append(run[i : end[i]])
            i = end[i]
        return out

    def paths(self, runs: list[str]) -> list[str]:
        return [word for run in runs for word in self.path(run)]

    def words(self, text: str | None) -> list[str]:
        out: list[str] = []
        for whole, runs in groupby(self.runs.findall((text or "").lower()), lambda run: self.ascii_words and run.isascii()):
            out += runs if whole else self.paths(list(runs))
        return out


class Children:
    """Numbers, from 0, of pairs of a parent's number and a character's. Where
    one of 16 pairs or more is known, a table has all of them; else the known
    ones lie in the order of their keys, with the places where the keys of each of
    their leading bits begin."""

    def __init__(self, pairs: np.ndarray, parents: int, base: int):
        self.base, self.keys, self.numbers = base, None, np.full(0, -1, np.int32)
        if parents * base <= 16 * len(pairs):
            self.numbers = np.full(parents * base, -1, np.int32)
            self.numbers[pairs] = np.arange(len(pairs))
            return
        keys = spread_keys(pairs)
        order = np.argsort(keys)
        bits = len(pairs).bit_length()
        self.keys, self.numbers, self.shift = np.append(keys[order], LAST_KEY), np.append(order, -1).astype(np.int32), np.uint64(64 - bits)
        self.begins = np.searchsorted(keys[order] >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def find(self, parents: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The numbers of these pairs, or -1."""
        if self.keys is None:
            return self.numbers[parents * self.base + characters]
        keys = spread_keys(parents * self.base + characters)
        place = self.begins[(keys >> self.shift).view(np.int64)].astype(np.int64)
        late = np.flatnonzero(self.keys[place] < keys)
        while len(late):
            place[late] += 1
            late = late[self.keys[place[late]] < keys[late]]
        return np.where(self.keys[place] == keys, self.numbers[place], np.int32(-1))


class PackedWords:
    """Words with their counts as a trie in arrays, whose nodes are the beginnings
    of words. For each length there are the children of the nodes before, and for
    each node the score of the word that it is, or NaN."""

    def __init__(self, words: pa.Array, counts: pa.Array):
        counts = counts.to_numpy()
        total = math.log(int(counts.sum()) or 1)
        kinds, at = np.unique(counts, return_inverse=True)
        scores = np.array([math.log(int(n)) - total for n in kinds])[at]
        self.alone = -total
        lengths = pc.utf8_length(words).to_numpy()
        order = np.argsort(lengths, kind="stable")
        sizes, starts = np.unique(lengths[order], return_index=True)
        cells, score = {}, {}
        for size, start, stop in zip(sizes.tolist(), starts, np.append(starts, len(order))[1:], strict=True):
            rows = order[start:stop]
            cells[size] = points("".join(words.take(pa.array(rows)).to_pylist())).reshape(-1, size)
            score[size] = scores[rows]
        alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.unique(c) for c in cells.values())]))
        self.codes, base = np.zeros(0x110000, np.int32), len(alphabet) + 1  # 0: in no word
        self.codes[alphabet] = np.arange(1, base)
        self.levels, parents, count = [], {size: np.zeros(len(c), np.int64) for size, c in cells.items()}, 1
        for n in range(1, max(cells, default=0) + 1):
            pairs = {size: parent * base + self.codes[cells[size][:, n - 1]] for size, parent in parents.items()}
            whole = pairs.pop(n, np.zeros(0, np.int64))
            nodes = np.unique(np.concatenate([whole, *pairs.values()]))
            known = np.full(len(nodes), np.nan)
            known[np.searchsorted(nodes, whole)] = score.get(n, 0.0)
            self.levels.append((Children(nodes, count, base), known))
            parents, count = {size: np.searchsorted(nodes, p) for size, p in pairs.items()}, len(nodes)

    def found(self, codes: np.ndarray, behind: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, places behind, scores) of the words that begin at these places,
        shorter ones first. Of each place `codes` has the character's number and
        `behind` the place behind it."""
        node, end = np.zeros(len(at), np.int64), at
        for children, scores in self.levels:
            node = children.find(node, codes[end])
            known = np.flatnonzero(node >= 0)
            at, end, node = at[known], behind[end[known]], node[known].astype(np.int64)
            score = scores[node]
            word = np.flatnonzero(~np.isnan(score))
            yield at[word], end[word], score[word]
            if not len(at):
                break


def spread_keys(pairs: np.ndarray) -> np.ndarray:
    """Numbers over 64 bits, a different one for each, as the factor is odd."""
    return pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PackedGraph(WordGraph):
    """The same paths as WordGraph's, with the words as arrays. Many runs are
    walked together, a character of each at a time from their ends; the last few,
    which are the longest, one by one."""

    def __init__(self, packed: PackedWords, ascii_words: bool = True):
        self.packed, self.alone, self.ascii_words = packed, packed.alone, ascii_words
        self.runs = regex.compile(RUN_BESIDE_ASCII if ascii_words else RUN, regex.V1)

    def path(self, run: str) -> list[str]:
        starts = np.sort(self.starts([run], np.zeros(1, np.int64))).tolist()
        return [run[i:j] for i, j in pairwise([*starts, len(run)])]

    def words(self, text: str | None) -> list[str]:
        return self.split(pa.array([text], pa.string()))[0].as_py()

    def split(self, texts: pa.Array) -> pa.Array:
        """The list of words of each text."""
        found = [self.runs.findall((text or "").lower()) for text in texts.to_pylist()]
        runs = list(chain.from_iterable(found))
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        begins = np.cumsum(sizes) - sizes
        walked = np.flatnonzero([not (self.ascii_words and run.isascii()) for run in runs])
        walked = walked[np.argsort(-sizes[walked], kind="stable")]  # runs of like lengths go together
        first = np.zeros(sizes.sum(), bool)
        first[begins] = True
        for block in np.split(walked, np.flatnonzero(np.diff(np.cumsum(sizes[walked]) // RUN_CHARACTERS)) + 1):
            first[self.starts([runs[i] for i in block], begins[block])] = True
        starts, joined = np.flatnonzero(first), "".join(runs)
        data, at = joined.encode(), starts
        if len(data) > len(joined):
            c = points(joined)
            at = np.cumsum(np.concatenate([[0], 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)]))[starts]
        offsets = pa.array(np.append(at, len(data)), pa.int32())
        values = pa.StringArray.from_buffers(len(starts), offsets.buffers()[1], pa.py_buffer(data))
        ends = np.cumsum([0, *(sum(map(len, some)) for some in found)])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends), pa.int32()), values)

    def starts(self, runs: list[str], at: np.ndarray) -> np.ndarray:
        """The places at which words begin, of runs that begin at these places and
        are given longest first. Characters that are as far from the ends of their
        runs are a row of cells; row 0 is behind the runs."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        alive = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0) + 1), "right")
        rows = np.concatenate([[0], np.cumsum(alive)])
        behind = np.arange(rows[-1]) - np.repeat(np.append(0, alive[:-1]), alive)
        ends = np.cumsum(sizes)
        cell = rows[np.repeat(ends, sizes) - np.arange(sizes.sum())] + np.repeat(np.arange(len(runs)), sizes)
        codes, place = np.zeros(rows[-1], np.int64), np.zeros(rows[-1], np.int64)
        codes[cell] = self.packed.codes[points("".join(runs))]
        place[cell] = np.arange(sizes.sum()) + np.repeat(at - ends + sizes, sizes)
        edges, goal, score = self._edges(codes, behind, len(runs))
        best, done, chosen = self._best(edges, goal, score, rows)
        i, out = rows[sizes] + np.arange(len(runs)), [np.zeros(0, np.int64)]
        for n in np.flatnonzero(i >= done).tolist():
            c, passed = int(i[n]), []
            while c >= done:
                passed.append(c)
                c = chosen[c - done]
            i[n] = c
            out.append(place[passed])
        i = i[i >= len(runs)]
        while len(i):
            out.append(place[i])
            edge, top = edges[i + 1] - 1, best[i]  # of equal words the last, the longest
            late = np.flatnonzero(score[edge] + best[goal[edge]] != top)
            while len(late):
                edge[late] -= 1
                late = late[score[edge[late]] + best[goal[edge[late]]] != top[late]]
            i = goal[edge]
            i = i[i >= len(runs)]
        return np.concatenate(out)

    def _edges(self, codes: np.ndarray, behind: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each cell's words begin and end in the list of all words, by cell
        and length, and the cell behind and score of each word."""
        count, found = np.zeros(len(codes), np.int32), []
        for here, there, scores in self.packed.found(codes, behind, np.arange(ends, len(codes))):
            nth = count[here]
            count[here] = nth + 1
            found.append((here, there, nth, scores))
        lone = ends + np.flatnonzero(count[ends:] == 0)
        count[lone] = 1
        found.append((lone, behind[lone], 0, self.alone))
        edges = np.concatenate([[0], np.cumsum(count)])
        goal, score = np.zeros(edges[-1], np.int64), np.zeros(edges[-1])
        for here, there, nth, scores in found:
            edge = edges[here] + nth
            goal[edge], score[edge] = there, scores
        return edges, goal, score

    def _best(self, edges: np.ndarray, goal: np.ndarray, score: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, int, array]:
        """The score of the best path from each cell; the first cell of the rows
        of few runs, and for each cell from there on the next one of its path."""
        best, done, chosen = np.zeros(rows[-1]), int(rows[1]), array("q")
        first = edges[:-1] - np.repeat(edges[rows[:-1]], np.diff(rows))
        bounds = edges[rows].tolist()
        rows = rows.tolist()
        for k in range(1, len(rows) - 1):
            a, b, i, j = rows[k], rows[k + 1], bounds[k], bounds[k + 1]
            if b - a < FEW_RUNS:
                break
            best[a:b] = np.maximum.reduceat(score[i:j] + best[goal[i:j]], first[a:b])
            done = b
        for a in range(done, len(best), RUN_CHARACTERS // 8):
            b = min(len(best), a + RUN_CHARACTERS // 8)
            goals, scores = goal[edges[a] : edges[b]], score[edges[a] : edges[b]].tolist()
            low, i = int(goals.min()), 0
            ways, goals = best[low:a].tolist(), (goals - low).tolist()
            for n in np.diff(edges[a : b + 1]).tolist():
                to = goals[i]
                top = scores[i] + ways[to]
                for k in range(i + 1, i + n):  # shortest first, so a longer one of the same score counts
                    way = scores[k] + ways[goals[k]]
                    if way >= top:
                        top, to = way, goals[k]
                i += n
                ways.append(top)
                chosen.append(to + low)
            best[a:b] = ways[a - low :]
        return best, done, chosen


def word_counts(dictionary: DataFrame, most: int | None = None) -> pa.Table:
    """The counts of a dictionary (word, n), lower-cased, as tasks need them
    whole. More than `most` words are an error where that is given."""
    rows = dictionary.filter("word <> '' AND n > 0").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    found = (rows if most is None else rows.limit(most + 1)).toArrow()
    if most is not None and found.num_rows > most:
        raise ValueError(f"the dictionary has more than {most} words")
    return found.combine_chunks()


def segmenter(dictionary: DataFrame, ascii_words: bool = True, most: int | None = None):
    """A function from a text column to its words, to be used wherever `tokens`
    is. Null texts have no words; white space and punctuation part runs."""
    counts = word_counts(dictionary, most)
    whole = lambda c: pa.concat_arrays(counts.column(c).chunks) if counts.num_rows else pa.array([], counts.schema.field(c).type)
    shared = dictionary.sparkSession.sparkContext.broadcast(PackedWords(whole("word"), whole("n")))

    @F.arrow_udf(ArrayType(StringType()))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        graph = PackedGraph(shared.value, ascii_words)
        for texts in batches:
            share = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_CHARACTERS
            bounds = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(texts)]
            for start, stop in pairwise(bounds):
                yield graph.split(texts[start:stop])

    def words(text: Column) -> Column:
        return cut(text)

    return words


def cohesive_words(texts: DataFrame, text_col: str = "text", longest: int = 4, least_count: int = 5, least_cohesion: float = 20.0) -> DataFrame:
    """A dictionary (word, n) learned from texts without spaces: character runs
    of 2 to `longest` that come `least_count` times or more and whose parts meet
    `least_cohesion` times as often as by chance at every place to part them, and
    all single characters. Only counts are shuffled."""
    run = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"([\p{L}\p{M}\p{N}&&[^A-Za-z0-9]]+)"), F.lit(1)))
    runs = texts.select(run.alias("run"))
    cut = F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda k: k <= F.length("run")), lambda k: F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substring("run", i, k))))
    counts = runs.select(F.explode(cut).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = counts.filter((F.length("word") == 1) | (F.col("n") >= least_count))
    total = runs.agg(F.sum(F.length("run"))).first()[0] or 1
    parts = counts.filter(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    parts = parts.select("word", "n", F.substring("word", F.lit(1), F.col("i")).alias("a"), F.substring("word", F.col("i") + 1, F.length("word")).alias("b"))
    sized = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    cohesion = F.min(F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b")))
    whole = parts.join(sized("a"), "a").join(sized("b"), "b").groupBy("word", "n").agg(cohesion.alias("cohesion")).filter(F.col("cohesion") >= least_cohesion)
    return counts.filter(F.length("word") == 1).unionByName(whole.select("word", "n"))
