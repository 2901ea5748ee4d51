"""Queries that SQL can't express beside plain Python over the same tables."""

import re
import struct
from collections import defaultdict, deque

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import hybrid
from lodestone.plans import registry
from lodestone.sources.documents import html_to_markdown

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def result(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def words_of(text):
    return re.findall(r"[a-zA-Z0-9_]+", (text or "").lower(), re.ASCII)


def scaled(hits):
    """Hits (query, id, score, rank) with scores scaled within each query."""
    by = defaultdict(list)
    for r in hits:
        by[r["query_id"]].append(r)
    for own in by.values():
        low, high = min(r["score"] for r in own), max(r["score"] for r in own)
        yield [(r["query_id"], r["id"], 0.5 if high == low else (r["score"] - low) / (high - low), r["rank"]) for r in sorted(own, key=lambda r: r["rank"])]


def test_mmr_select(spark):
    bags = {r["doc_id"]: {w for w in words_of(r["text"]) if len(w) >= 2} for r in rows(spark, "documents")}
    found = {(r["query_id"], r["rank"]): r["id"] for r in result(spark, "mmr_select")}
    n = 0
    for hits in scaled(result(spark, "bm25_topk")):
        chosen, left = [hits[0]], hits[1:]
        while left and len(chosen) < 5 and len(hits) > 5:
            like = lambda h: max(len(bags[h[1]] & bags[c[1]]) / max(1, len(bags[h[1]] | bags[c[1]])) for c in chosen)  # noqa: B023, E731
            best = max(left, key=lambda h: 0.5 * h[2] - 0.5 * like(h))  # noqa: B023
            chosen.append(best)
            left.remove(best)
        chosen = hits if len(hits) <= 5 else chosen
        assert [found[hits[0][0], i + 1] for i in range(len(chosen))] == [h[1] for h in chosen]
        n += len(chosen)
    assert n == len(found)


def test_cross_rerank(spark):
    import math

    raw = {r["doc_id"]: math.log1p(len(r["text"])) if r["text"] is not None else None for r in rows(spark, "documents")}
    found = {(r["query_id"], r["id"]): r["cross_score"] for r in result(spark, "cross_rerank")}
    for hits in scaled(result(spark, "bm25_topk")):
        low, high = min(raw[h[1]] for h in hits), max(raw[h[1]] for h in hits)
        for q, i, score, _ in hits:
            assert found[q, i] == pytest.approx(min(1.0, score + 0.25 * (0.5 if high == low else (raw[i] - low) / (high - low))), abs=2e-6)


def test_trace_sample(spark):
    events = [r["event_id"] for r in rows(spark, "events")]
    picked = {i for i in events if struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0] % 1_000_000 < 100_000}
    assert {r["event_id"] for r in result(spark, "trace_sample")} == picked and 0 < len(picked) < len(events) / 5


def test_rate_limit_window(spark):
    accepted = {r["id"]: r["accepted"] for r in result(spark, "rate_limit_window")}
    recent = defaultdict(deque)
    events = rows(spark, "events")
    for r in sorted(events, key=lambda r: (r["ts"], r["event_id"])):
        own = recent[r["user_id"]]
        while own and (r["ts"] - own[0]).total_seconds() >= 86_400:
            own.popleft()
        assert accepted[r["event_id"]] == (len(own) < 3)
        if len(own) < 3:
            own.append(r["ts"])
    assert len(accepted) == len(events)


def test_paragraph_pack(spark):
    found = defaultdict(dict)
    for r in result(spark, "paragraph_pack"):
        found[r["doc_id"]][r["place"]] = r["chunk"]
    for r in rows(spark, "documents"):
        out = []
        for part in (p.strip(BLANK) for p in re.split(r"\n\s*\n", (r["text"] or "").replace("\n", "\n\n"))):
            if not part:
                continue
            if out and len(out[-1]) + 2 + len(part) <= 400:
                out[-1] += "\n\n" + part
            else:
                out.append(part)
        assert [found[r["doc_id"]][i] for i in range(len(found[r["doc_id"]]))] == out


def test_section_paths(spark):
    found = defaultdict(list)
    for r in sorted(result(spark, "section_paths"), key=lambda r: (r["page_id"], r["place"])):
        found[r["page_id"]].append((r["path"], r["body"]))
    for r in rows(spark, "pages"):
        text, stack, out, body = html_to_markdown(r["html"]), [], [], []
        whole = re.search(r"(?m)^#{1,6}\s+\S", text) is None

        def flush():
            said = "\n".join(body).strip(BLANK)  # noqa: B023
            if said and (stack or whole):  # noqa: B023
                out.append((" / ".join(t for _, t in stack), said))  # noqa: B023

        for line in text.split("\n"):
            head = re.match(r"(#{1,6})\s+(.+?)\s*$", line)
            if head:
                flush()
                body = []
                stack = [h for h in stack if h[0] < len(head[1])] + [(len(head[1]), head[2])]
            else:
                body.append(line)
        flush()
        assert found[r["page_id"]] == out, r["page_id"]


def test_served_search_is_diverse_and_hides_what_readers_may_not_see(spark):
    texts = [(1, "a", "", "", "red fox runs far"), (2, "b", "", "", "red fox runs far"), (3, "c", "", "", "red fox sleeps"), (4, "d", "law", "", "red fox hides"), (5, "e", "", "clerk", "red fox waits"), (6, "f", "", "", "blue owl"), (7, "g", "", "", "red fox runs on")]
    docs = spark.createDataFrame([(i, *r) for i, *r in texts], "id long, doc_id string, dept string, roles string, text string").withColumns({"title": F.lit("t"), "vector": V.character_vector("text")})
    asked = spark.createDataFrame([(1, "red fox", "sales", "user"), (2, "red fox", "law", "clerk"), (3, "red fox", "", "admin")], "query_id long, q string, user_dept string, user_role string")
    split = F.split("q", " ")
    asked = asked.withColumns({"vector": V.character_vector("q"), "variants": F.array(split), "terms": split})
    blocked = spark.createDataFrame([("g",)], "doc_id string")
    found = defaultdict(list)
    for r in sorted(hybrid.served_search(docs, asked, F.split("text", " "), blocked, 4).collect(), key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["id"])
    assert 4 not in found[1] and 5 not in found[1] and 7 not in sum(found.values(), [])
    assert {4, 5} <= set(found[2]) and {4, 5} <= set(found[3])
    best = hybrid.mixed_search(docs, asked.filter("query_id = 3"), F.split("text", " "), 3).orderBy("rank").collect()
    assert len({texts[r["id"] - 1][4] for r in best}) == 3  # the repeated text gives way
    plain = hybrid.mixed_search(docs, asked.filter("query_id = 3"), F.split("text", " "), 3, lam=None).orderBy("rank").collect()
    assert [r["rank"] for r in plain] == [1, 2, 3] and plain[0]["id"] == best[0]["id"]
