"""Conversations, feedback, issues, memories and traces over append tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import records as D
from lodestone.functions import text as T
from lodestone.operators import blocks as B
from lodestone.operators import history as H
from lodestone.operators.numbering import numbered
from lodestone.operators.retrieval import QUERIES_AT_ONCE, dense_search, dropoff_cut, ranked
from lodestone.session import staged

PLACEHOLDER = "新对话"  # fixed value: the title of conversations that nobody has named
ISSUE_STATES = ["open", "confirmed", "resolved", "ignored"]
NEEDS_NOTE = ["resolved", "ignored"]


def owned_conversations(conversations: DataFrame, owner: Column, keyword: str = "") -> DataFrame:
    """Conversations of an owner that aren't deleted and whose title holds the keyword in any case."""
    kept = conversations.filter(F.col("deleted_at").isNull() & (F.col("user_id") == owner))
    return kept.filter(F.contains(F.lower("title"), F.lit(keyword.lower()))) if keyword else kept


def soft_delete(rows: DataFrame, keys: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows with deleted_at set where `keys` names them; those deleted before keep their time."""
    named = keys.select(key).distinct().withColumn("named", F.lit(True))
    return rows.join(named, key, "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("named"), now))).drop("named")


def own_orphans(rows: DataFrame, owner: str) -> DataFrame:
    return rows.withColumn("user_id", F.coalesce(F.nullif("user_id", F.lit("")), F.lit(owner)))


def named_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Placeholder titles taken from each conversation's first question; other titles stay."""
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    bare = F.coalesce(T.strip(F.col("title")), F.lit("")).isin("", PLACEHOLDER)
    return conversations.join(first, "conv_id", "left").withColumn("title", F.when(bare, T.title_of(F.col("question"), default=PLACEHOLDER)).otherwise(F.col("title"))).drop("question")


def review_issues(issues: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, accepted reviews): reviews (id, to_status, reviewer, note, at)
    of known issues (id, status) move them to a known state; closing ones need
    a note that isn't blank. Each review records the state before it, the last
    one stays; reviews of one moment go by state, reviewer and note."""
    sound = F.col("to_status").isin(ISSUE_STATES) & (~F.col("to_status").isin(NEEDS_NOTE) | (T.strip(F.coalesce("note", F.lit(""))) != ""))
    before = F.expr("lag(to_status) OVER (PARTITION BY id ORDER BY at, to_status, reviewer, note)")
    accepted = reviews.filter(sound).join(issues.select("id", "status"), "id").withColumn("from_status", F.coalesce(before, "status")).drop("status")
    last = accepted.groupBy("id").agg(F.max_by(F.struct("to_status", "reviewer"), F.struct("at", "to_status", "reviewer", "note")).alias("r"))
    moved = issues.join(last, "id", "left").withColumn("status", F.coalesce("r.to_status", "status")).withColumn("reviewer", F.col("r.reviewer")).drop("r")
    return moved, accepted


def feedback_rows(messages: DataFrame, conversations: DataFrame, golden: DataFrame, wanted: str = "") -> DataFrame:
    """Assistant messages (conv_id, turn, role, text, details) with feedback in
    their details: the question before them, the owner, refused, evidence_gap
    and whether the golden set (query) has the question."""
    flag = lambda k: F.coalesce(F.get_json_object("details", f"$.{k}") == "true", F.lit(False))
    rows = H.question_of(messages).withColumn("feedback", F.get_json_object("details", "$.feedback")).filter(F.coalesce("feedback", F.lit("")) != "")
    rows = rows.filter(F.col("feedback") == wanted.strip().lower()) if wanted else rows
    rows = rows.join(conversations.select("conv_id", "title", "user_id"), "conv_id").withColumn("question", F.coalesce("question", F.lit("")))
    known = golden.select(F.col("query").alias("question")).distinct().withColumn("in_golden", F.lit(True))
    rows = rows.join(known, "question", "left")
    return rows.select("conv_id", "turn", "title", F.coalesce("user_id", F.lit("")).alias("user_id"), "question", F.col("text").alias("answer"), "feedback", flag("refused").alias("refused"), (flag("evidence_gap") | flag("refused")).alias("evidence_gap"), F.coalesce("in_golden", F.lit(False)).alias("in_golden"))


def bad_cases(feedback: DataFrame, known: DataFrame) -> DataFrame:
    """Redacted questions of bad feedback that the dataset (query) lacks, each
    once with how often it came."""
    asked = feedback.filter("feedback = 'down' AND question <> ''").select(T.redact(F.col("question")).alias("query"))
    return asked.groupBy("query").agg(F.count("*").alias("times")).join(known.select("query").distinct(), "query", "left_anti")


def golden_summary(golden: DataFrame) -> DataFrame:
    labelled = F.count_if(F.size(F.coalesce("expect", F.array().cast("array<string>"))) > 0)
    return golden.agg(F.count("*").alias("total"), labelled.alias("labelled"), (F.count("*") - labelled).alias("pending"))


def memory_search(memories: DataFrame, asked: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """For each query (query_id, user_id, vector) the k best memories (id,
    user_id, vector) of its user only, without those of similarity 0 or less.
    Vectors of other lengths count as 0.

    Queries are stored in blocks, which meet chunks of memories. A task
    multiplies the memories of each user with that user's queries and passes on
    the k best of each, so neither pairs nor a user with very many memories are
    shuffled.
    """
    asked = asked.filter("user_id IS NOT NULL AND vector IS NOT NULL").select("query_id", F.col("user_id").cast("string").alias("user_id"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = B.query_blocks(asked, asked.count(), QUERIES_AT_ONCE)

    def groups(users: pa.Array, vectors: pa.Array) -> dict:
        sizes = vectors.value_lengths().to_pylist()
        return pd.Series(range(len(sizes))).groupby([users.to_pylist(), sizes]).indices

    def prepare(ids: pa.Array, users: pa.Array, vectors: pa.Array):
        number = ids.to_numpy()
        return number, {key: (at, B.matrix_of(vectors.take(pa.array(at))).T) for key, at in groups(users, vectors).items()}

    def score(asked, ids: pa.Array, users: pa.Array, vectors: pa.Array):
        number, known = ids.to_numpy(), asked[1]
        for key, at in groups(users, vectors).items():
            if key in known:
                places, matrix = known[key]
                rows = max(1, B.TILE_CELLS // len(places))
                for start in range(0, len(at), rows):
                    own = at[start : start + rows]
                    scores = B.matrix_of(vectors.take(pa.array(own))) @ matrix
                    yield number[own], np.round(scores, digits, out=scores), places

    held = memories.filter("user_id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("user_id").cast("string").alias("user_id"), "vector")
    return ranked(B.search(held, blocks, k, prepare, score, 0.0, QUERIES_AT_ONCE), k)


def forget(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """Facts without those of the given (user_id, subject, predicate)."""
    return facts.join(keys.select("user_id", "subject", "predicate").distinct(), ["user_id", "subject", "predicate"], "left_anti")


def memory_context(asked: DataFrame, facts: DataFrame, profiles: DataFrame, turns: DataFrame) -> DataFrame:
    """(query_id, context): remembered triples (query_id, rank, text), the
    profile (query_id, k, v) without empty values and the recent turns
    (query_id, turn, role, text) above the current input. All three lists are
    bounded by the searches before."""
    lines = lambda df, line, order: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    parts = [
        ("【长期记忆】\n", lines(facts, F.concat(F.lit("- "), "text"), "rank"), "facts"),
        ("【用户画像】\n", lines(profiles.filter("v IS NOT NULL AND v <> ''"), F.concat(F.lit("- "), "k", F.lit(": "), "v"), "k"), "profile"),
        ("", lines(turns, F.concat(F.when(F.col("role") == "user", "用户：").otherwise("助手："), "text"), "turn"), "turns"),
    ]
    out = asked.select("query_id", "input")
    for _, df, name in parts:
        out = out.join(df.withColumnRenamed("lines", name), "query_id", "left")
    told = [F.concat(F.lit(head), F.col(name)) for head, _, name in parts]
    return out.select("query_id", F.concat_ws("\n\n", *told, F.concat(F.lit("【当前输入】\n"), "input")).alias("context"))


def import_batches(edges: DataFrame, nodes: DataFrame, done: DataFrame, size: int = 500) -> DataFrame:
    """Relation batches (relation, src_label, dst_label, batch) still to be
    imported: edges in order of their ends, `size` each, with how many of them
    will be lost for want of an end; nodes may repeat. Batches of `done` are
    skipped. Edges are numbered over the whole table, and a relation's own
    numbers begin at its first one, so no task holds a relation."""
    by, ends = ["relation", "src_label", "dst_label"], nodes.select("label", "id").distinct()
    known = lambda label, end: ends.select(F.col("label").alias(label), F.col("id").alias(end), F.lit(1).alias(f"has_{end}"))
    placed = numbered(edges.select(*by, "src", "dst"), [F.col(c) for c in (*by, "src", "dst")], "place")
    first = placed.groupBy(*by).agg(F.min("place").alias("first"))  # one row a relation; a join by it would deal a relation to one task
    placed = placed.join(F.broadcast(first), by).withColumn("batch", ((F.col("place") - F.col("first")) / size).cast("int"))
    placed = placed.join(known("src_label", "src"), ["src_label", "src"], "left").join(known("dst_label", "dst"), ["dst_label", "dst"], "left")
    counts = placed.groupBy(*by, "batch").agg(F.count("*").alias("edges"), F.count_if(F.col("has_src").isNull() | F.col("has_dst").isNull()).alias("lost"))
    return counts.join(done.select(*by, "batch").distinct(), [*by, "batch"], "left_anti")


def merge_extractions(rules: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rule results with what a model found for the same document behind them, as a bag."""
    model = cached.join(rules.select(key).distinct(), key, "left_semi")
    return rules.unionByName(model, allowMissingColumns=True)


def match_entities(hits: DataFrame, least: float = 0.6, ratio: float = 0.6) -> DataFrame:
    """Hits (query_id, id, score) of all names of a query: each entity once with
    its best score, in order, up to the first sharp drop."""
    best = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return dropoff_cut(ranked(best), least, ratio)


def typed_entities(entities: DataFrame, named: DataFrame, kinds: dict[str, str], k: int = 3, least: float = 0.6, ratio: float = 0.6) -> DataFrame:
    """(query_id, category, id, score, rank): what the names (query_id,
    category, name, vector) of questions stand for among entities (id, type,
    vector). `kinds` gives the type of each category, and a name finds entities
    of that type alone; names of other categories find none. Of each name the k
    nearest of `least` similarity or more count, up to the first sharp drop; of
    each category each entity once with its best score. Vectors are those of
    `Type: name` texts."""
    types = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    asked = staged(named.select("query_id", "category", types[F.col("category")].alias("type"), "vector").filter("type IS NOT NULL").withColumn("name_id", F.monotonically_increasing_id()), "typed-names")
    found = None
    for kind in dict.fromkeys(kinds.values()):  # a few fixed types
        own = asked.filter(F.col("type") == kind).select(F.col("name_id").alias("query_id"), "vector")
        hits = dropoff_cut(dense_search(entities.filter(F.col("type") == kind).select("id", "vector"), own, k), least, ratio)
        found = hits if found is None else found.unionByName(hits)
    met = found.select(F.col("query_id").alias("name_id"), "id", "score").join(asked.select("name_id", "query_id", "category"), "name_id")
    best = met.groupBy("query_id", "category", "id").agg(F.max("score").alias("score"))
    return ranked(best, by="query_id, category")


def spans(events: DataFrame) -> DataFrame:
    """Latency, time to the first token and cost of each trace (trace_id, kind,
    ts, tokens_in, tokens_out), whose kinds are start, first and end."""
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    ms = lambda a, b: (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1000
    sums = events.groupBy("trace_id").agg(at("start").alias("t0"), at("first").alias("t1"), at("end").alias("t2"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return sums.select("trace_id", ms("t0", "t2").alias("latency_ms"), ms("t0", "t1").alias("first_token_ms"), F.round(F.col("tokens_in") / 1e6 + F.col("tokens_out") / 1e6 * 3, 9).alias("cost"))


def trace_summary(traces: DataFrame, size: int = 2000) -> DataFrame:
    """String fields redacted and cut to `size`, others as they are."""
    return traces.select(*[T.truncate(T.redact(F.col(c)), size).alias(c) if kind == "string" else F.col(c) for c, kind in traces.dtypes])


def thumb_score(feedback: Column) -> Column:
    return F.when(feedback == "up", 1.0).when(feedback == "down", 0.0)


def result_table(rows: DataFrame, group: str, order: str, cells: list[str], most: int = 200) -> DataFrame:
    """Each group's rows as lines of cells, the first `most` of them, with a
    note on how many there are where some are left out."""
    head = [" | ".join(cells), "-" * 40]
    line = F.array_join(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cells]), " | ")
    total = rows.groupBy(group).agg(F.count("*").alias("n"))
    top = rows.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY {group} ORDER BY {order})")).filter(F.col("place") <= most)
    lists = top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    note = F.when(F.col("n") > most, F.array(F.concat(F.lit("... (截断，共 "), F.col("n").cast("string"), F.lit(f" 条，显示前 {most} 条)")))).otherwise(F.array().cast("array<string>"))
    return lists.join(total, group).select(group, F.array_join(F.concat(F.lit(head), "lines", note), "\n").alias("body"))
