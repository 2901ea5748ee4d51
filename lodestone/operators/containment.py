"""Which of many terms a text contains, as substrings.

The terms of a block become one automaton in each task, which walks a text once
whatever their number. A block holds BLOCK_BYTES of terms at most, so what is
sent to tasks is bounded; a longer list takes one pass over the texts a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import blocks as B
from lodestone.operators.retrieval import ROWS_AT_ONCE, bm25_search, ranked
from lodestone.session import staged

BLOCK_BYTES = 32 << 20
QUERIES_AT_ONCE = 1024
LEAST_CHARACTERS = 2
MOST_TERMS = 20


def automaton(terms: dict):
    """An automaton of terms (not empty) and what each stands for."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, value in terms.items():
        found.add_word(term, (len(term), value))
    if terms:
        found.make_automaton()
    return found


def contained_terms(texts: DataFrame, terms: DataFrame, most: int | None = None) -> DataFrame:
    """(id, place, term, n, first) of the terms (place, term) that each text
    (id, text) contains: how often, overlaps counted, and where it begins first,
    from 0. With `most`, only a text's first terms by place. Null and empty
    texts hold nothing, null and empty terms are in nothing; of equal terms the
    smallest place counts."""
    terms = staged(terms.filter("term <> ''").groupBy("term").agg(F.min("place").alias("place")), "terms")
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    blocks = math.ceil(size / BLOCK_BYTES) or 1
    kind = texts.schema["id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        own = {r["term"]: r["place"] for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).collect()}  # BLOCK_BYTES, about

        def held(batches: Iterator[pd.DataFrame], own=own) -> Iterator[pd.DataFrame]:
            known = automaton({term: (place, term) for term, place in own.items()})
            for batch in batches:
                out = []
                for i, text in zip(batch["id"], batch["text"], strict=True):
                    hits: dict[tuple[int, str], list[int]] = {}
                    for end, (length, value) in known.iter(text) if own and text else ():
                        hit = hits.setdefault(value, [0, end - length + 1])
                        hit[0] += 1
                    out += [(i, place, term, *hit) for (place, term), hit in sorted(hits.items())[:most]]
                yield pd.DataFrame(out, columns=["id", "place", "term", "n", "first"])

        hits = texts.select("id", "text").mapInPandas(held, f"id {kind}, place long, term string, n long, first long")
        found = hits if found is None else found.unionByName(hits)
    if most and blocks > 1:
        found = ranked(found, most, "place, term", "id").drop("rank")
    return found


def contained_search(docs: DataFrame, queries: DataFrame, k: int, least: int = LEAST_CHARACTERS) -> DataFrame:
    """The k documents (id, text) that contain most of a query's distinct terms
    (query_id, terms), as substrings: (query_id, id, score, rank). Terms of
    fewer than `least` characters don't count.

    Queries are stored in blocks, which meet chunks of documents. A task walks a
    document once for all queries of a block and passes on the k best of each, so
    a common term makes no rows of its own.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).filter(F.length("term") >= least)
    blocks = B.query_blocks(asked, queries.count(), QUERIES_AT_ONCE)

    def prepare(queries: pa.Array, terms: pa.Array):
        ids, at = np.unique(queries.to_numpy(), return_inverse=True)
        return ids, automaton({term: at[i] for term, i in pd.Series(terms.to_pylist()).groupby(terms.to_pylist()).indices.items()})

    def score(asked, ids: pa.Array, texts: pa.Array):
        queries, known = asked
        for start in range(0, len(ids), ROWS_AT_ONCE):
            part = texts.slice(start, ROWS_AT_ONCE).to_pylist()
            scores = np.zeros((len(part), len(queries)))
            for row, text in enumerate(part):
                held = {id(v): v for _, (_, v) in known.iter(text)} if text else {}
                if held:
                    scores[row] = np.bincount(np.concatenate(list(held.values())), minlength=len(queries))
            yield ids.slice(start, ROWS_AT_ONCE).to_numpy(), scores

    return ranked(B.search(docs.select(F.col("id").cast("long").alias("id"), "text"), blocks, k, prepare, score, 0.0), k)


def sparse_search(docs: DataFrame, queries: DataFrame, words: Column, k: int) -> DataFrame:
    """The k best documents (id, text) of each query (query_id, and the word
    lists of its variants), by the best BM25 score of any variant; a query of
    which no variant scores takes the count of contained terms instead. A
    document among the k best is among the k best of the variant that scores it
    highest, so variants are searched one by one."""
    each = staged(queries.select(F.col("query_id").alias("whole"), F.explode("variants").alias("asked")).withColumn("query_id", F.monotonically_increasing_id()), "query-variants")
    hits = bm25_search(docs, each, words, F.col("asked"), k).join(each.select("query_id", "whole"), "query_id")
    best = staged(hits.groupBy(F.col("whole").alias("query_id"), "id").agg(F.max("score").alias("score")), "sparse-best")
    left = staged(queries.join(best, "query_id", "left_anti").select("query_id", F.flatten("variants").alias("terms")), "sparse-left")
    if left.isEmpty():
        return ranked(best, k)
    return ranked(best.unionByName(contained_search(docs, left, k).drop("rank")), k)
