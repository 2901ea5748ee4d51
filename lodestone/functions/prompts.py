"""Texts that are put together for a model or an interface: prompts, details, extraction input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Headings and stand-ins of the prompts, and the headings whose sections a model reads.
NO_GRAPH, NO_TEXTS, NO_MATCH = "(无图谱数据)", "(无文献摘录)", "  (无匹配实体)"
READ_HEADINGS = ["主治", "功效", "功用", "注意", "禁忌", "用法", "药方", "名称"]


def effective_question(rewritten: Column, original: Column) -> Column:
    """The rewritten question where there is one, else the user's."""
    return F.coalesce(F.nullif(T.strip(F.coalesce(rewritten, F.lit(""))), F.lit("")), T.strip(F.coalesce(original, F.lit(""))))


def standalone_question(question: Column, answered: Column, has_history: Column) -> Column:
    """What a model made of a question: its first line without quotes; the
    question itself without a history, an answer or anything in it."""
    question = T.strip(F.coalesce(question, F.lit("")))
    line = F.substring_index(T.strip(F.coalesce(answered, F.lit(""))), "\n", 1)
    bare = F.regexp_replace(T.strip(line), "^[\"'“”]+|[\"'“”]+$", "")
    return F.when(has_history & (bare != ""), bare).otherwise(question)


def matched_summary(matched: Column, kinds: list[str]) -> Column:
    """Matched entities, an array of (kind, name, id), by lines of `kinds`."""
    lines = []
    for kind in kinds:
        own = F.filter(matched, lambda e: e["kind"] == kind)  # noqa: B023  built at once
        items = F.array_join(F.transform(own, lambda e: F.concat(e["name"], F.lit("(id:"), e["id"], F.lit(")"))), ", ")
        lines.append(F.when(F.size(own) > 0, F.concat(F.lit(f"  {kind}: "), items)))
    joined = F.array_join(F.array_compact(F.array(*lines)), "\n")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_MATCH))


def query_prompt(schema: Column, matched: Column, question: Column) -> Column:
    return F.concat(F.lit("## 图 Schema\n"), schema, F.lit("\n\n## 匹配到的标准实体\n"), matched, F.lit("\n\n## 用户问题\n"), question, F.lit("\n\n请生成 Cypher 查询语句（JSON 数组格式）。"))


def answer_prompt(history: Column, graph: Column, texts: Column, question: Column) -> Column:
    """History, graph facts, excerpts and the question; what is empty is said so,
    an empty history is left out."""
    head = F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit("## 对话历史\n"), history, F.lit("\n\n"))).otherwise("")
    facts = F.coalesce(F.nullif(graph, F.lit("")), F.lit(NO_GRAPH))
    read = F.coalesce(F.nullif(T.strip(texts), F.lit("")), F.lit(NO_TEXTS))
    return F.concat(head, F.lit("## 知识图谱查询结果\n"), facts, F.lit("\n\n## 文献摘录\n"), read, F.lit("\n\n## 当前问题\n"), F.coalesce(question, F.lit("")), F.lit("\n\n请基于以上图谱数据与文献摘录回答用户问题。不要使用未出现的依据。"))


def details_json(**values: Column) -> Column:
    """An answer's details as JSON with a key for each value, nulls included;
    what was refused is a gap of evidence."""
    own = values | ({"evidence_gap": F.coalesce(values["refused"], F.lit(False))} if "refused" in values else {})
    return F.to_json(F.struct(*[v.alias(k) for k, v in own.items()]), {"ignoreNullFields": "false"})


def extraction_text(name: Column, meta: Column, sections: Column, headings: list[str] = READ_HEADINGS) -> Column:
    """What a model reads of a page: its name, its facts (key, value) and the
    sections (heading, children (heading, blocks), blocks) whose heading, or a
    child's, has one of `headings`; of these the children that have one."""
    keeps = lambda h: F.exists(F.lit(headings), lambda k: F.contains(F.coalesce(h, F.lit("")), k))
    said = lambda blocks: F.filter(F.coalesce(blocks, F.array().cast("array<string>")), lambda b: F.coalesce(b, F.lit("")) != "")
    facts = F.transform(F.filter(meta, lambda m: F.coalesce(m["value"], F.lit("")) != ""), lambda m: F.concat(m["key"], F.lit("："), m["value"]))

    def lines(s):
        children = F.coalesce(s["children"], F.array().cast("array<struct<heading:string,blocks:array<string>>>"))
        kept = F.filter(children, lambda c: keeps(c["heading"]))
        own = F.when(keeps(s["heading"]) | (F.size(children) == 0), F.array(F.concat(F.lit("\n【"), s["heading"], F.lit("】")))).otherwise(F.array().cast("array<string>"))
        below = F.flatten(F.transform(kept, lambda c: F.concat(F.array(F.concat(F.lit("\n"), c["heading"], F.lit("："))), said(c["blocks"]))))
        return F.when((F.size(kept) > 0) | keeps(s["heading"]), F.concat(own, below, said(s["blocks"]))).otherwise(F.array().cast("array<string>"))

    return F.array_join(F.concat(F.array(F.concat(F.lit("名称："), F.coalesce(name, F.lit("")))), facts, F.flatten(F.transform(sections, lines))), "\n")
