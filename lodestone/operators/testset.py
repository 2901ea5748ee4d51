"""Test sets: for each golden item the texts that hold what it expects."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.containment import automaton
from lodestone.operators.retrieval import dense_search, ranked

EXHAUSTIVE = 12  # candidates up to which the smallest cover is searched for
ITEMS_AT_ONCE = 1024
CANDIDATES = "query_id long, id long, score double, held array<int>"


def smallest_cover(held: list[set[int]], wanted: set[int]) -> list[int] | None:
    """Places of the fewest sets that together hold all of `wanted`, the first
    such in order; null if there are none. Greedy beyond EXHAUSTIVE sets: each
    step takes the first of those that add most."""
    if not wanted <= set().union(*held):
        return None
    if len(held) <= EXHAUSTIVE:
        ways = (c for n in range(len(held) + 1) for c in combinations(range(len(held)), n))
        return list(next(c for c in ways if wanted <= set().union(*(held[i] for i in c))))
    left, out = set(wanted), []
    while left:
        out.append(max(range(len(held)), key=lambda i: (len(held[i] & left), -i)))
        left -= held[out[-1]]
    return out


def cover_candidates(items: DataFrame, chunks: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, id, score, held): for each item (query_id, vector, expect,
    docs) and each set of its expected strings the k best of the chunks (id,
    doc, text, vector) that hold just these, by inner product.

    Items go in blocks, which the driver holds one at a time. A task finds the
    strings of a block in one walk of a text and keeps the best of each item
    and set, so a string that many texts hold makes no rows of its own. Where
    an item names documents only their chunks count.
    """
    blocks = math.ceil(items.count() / ITEMS_AT_ONCE) or 1
    found = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        asked = [(r["query_id"], np.array(r["vector"], dtype=np.float64), set(r["docs"] or [])) for r in rows]
        terms: dict[str, list[tuple[int, int]]] = {}
        for place, r in enumerate(rows):
            for i, e in enumerate(r["expect"]):
                terms.setdefault(e, []).append((place, i))

        def best(batches: Iterator[pd.DataFrame], asked=asked, terms=terms) -> Iterator[pd.DataFrame]:
            known = automaton(terms)
            kept: dict[tuple[int, tuple[int, ...]], list[tuple[float, int]]] = {}
            for batch in batches:
                for i, doc, text, vector in zip(batch["id"], batch["doc"], batch["text"], batch["vector"], strict=True):
                    held: dict[int, set[int]] = {}
                    for _, (_, uses) in known.iter(text) if terms and text else ():
                        for place, e in uses:
                            held.setdefault(place, set()).add(e)
                    for place, own in held.items():
                        _, wanted, docs = asked[place]
                        if docs and doc not in docs:
                            continue
                        score = round(float(np.dot(np.asarray(vector, dtype=np.float64), wanted)), digits)
                        top = kept.setdefault((place, tuple(sorted(own))), [])
                        top.append((-score, i))
                        if len(top) > 2 * k:
                            top.sort()
                            del top[k:]
            out = [(asked[place][0], i, -s, list(own)) for (place, own), top in kept.items() for s, i in sorted(top)[:k]]
            yield pd.DataFrame(out, columns=["query_id", "id", "score", "held"])

        hits = chunks.select("id", "doc", "text", "vector").mapInPandas(best, CANDIDATES)
        found = hits if found is None else found.unionByName(hits)
    return ranked(found, k, by="query_id, held").drop("rank")


def covering_contexts(items: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, ids, missing) of each item (query_id, expect): first the fewest
    candidates (query_id, id, score, held) that hold all expected strings, then
    the best others, up to k. What no candidate holds is `missing`, and such an
    item has no contexts. Candidates are k a set of strings at most, so an item's
    group is bounded by its own strings."""
    listed = items.select("query_id", "expect").join(candidates, "query_id", "left")

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wanted = list(rows["expect"].iloc[0])
        rows = rows[rows["id"].notna()].sort_values(["score", "id"], ascending=[False, True])
        ids, held = [int(i) for i in rows["id"]], [set(map(int, h)) for h in rows["held"]]
        cover = smallest_cover(held, set(range(len(wanted))))
        if cover is None:
            met = set().union(*held)
            return pd.DataFrame({"query_id": [key[0]], "ids": [[]], "missing": [[e for i, e in enumerate(wanted) if i not in met]]})
        chosen = sorted(cover) + [i for i in range(len(ids)) if i not in cover]
        return pd.DataFrame({"query_id": [key[0]], "ids": [[ids[i] for i in chosen[: max(k, len(cover))]]], "missing": [[]]})

    return listed.groupBy("query_id").applyInPandas(choose, "query_id long, ids array<long>, missing array<string>")


def make_test_set(items: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, contexts, reference, error) of golden items (query_id, vector,
    expect, docs, refuse) over chunks (id, doc, text, vector).

    Expected strings are trimmed, empty ones dropped. An item to be refused has
    no contexts; one that expects nothing takes its k nearest chunks of any
    document; one whose strings no chunks hold together is an error row and
    isn't lost. `reference` is the span of the first context around the first
    expected string.
    """
    none = F.array().cast("array<string>")
    clean = items.select("query_id", "vector", "docs", F.coalesce("refuse", F.lit(False)).alias("refuse"), F.array_distinct(T.clean_list(F.coalesce("expect", none))).alias("expect"))
    open_items = clean.filter(~F.col("refuse") & (F.size("expect") == 0))
    nearest = dense_search(chunks.select("id", "vector"), open_items.select("query_id", "vector"), k).select("query_id", "id", "score", F.array().cast("array<int>").alias("held"))
    wanting = clean.filter(~F.col("refuse") & (F.size("expect") > 0))
    chosen = covering_contexts(clean.filter(~F.col("refuse")), cover_candidates(wanting, chunks, k).unionByName(nearest), k)
    texts = chosen.select("query_id", F.posexplode("ids").alias("place", "id")).join(chunks.select("id", "text"), "id")
    lists = texts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.trim("text").alias("text")))), lambda x: x["text"]).alias("contexts"))
    rows = clean.select("query_id", "expect", "refuse").join(chosen, "query_id", "left").join(lists, "query_id", "left")
    first = F.element_at("contexts", 1)
    at = F.expr("CASE WHEN size(expect) > 0 THEN locate(expect[0], contexts[0]) ELSE 0 END")
    start = F.greatest(F.lit(1), at - 24)
    span = F.when(F.size(F.coalesce("contexts", none)) == 0, None).when(at > 0, F.substring(first, start, at + 160 - start)).otherwise(F.substring(first, 1, 160))
    error = F.when(F.size(F.coalesce("missing", none)) > 0, F.concat(F.lit("not covered: "), F.array_join("missing", ", ")))
    return rows.select("query_id", F.coalesce("contexts", none).alias("contexts"), F.coalesce(span, F.lit("")).alias("reference"), error.alias("error"))
