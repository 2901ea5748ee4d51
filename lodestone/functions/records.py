"""Functions over dates, JSON payloads, maps and rendered records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T

ZONE = r"(?:[Zz]|[+-]\d\d:?\d\d)$"
DAY = r"^\d{4}-\d\d-\d\d$"
LICENSE = "原文公有领域；维基文库整理 CC BY-SA 4.0"  # fixed value: the line of texts that state none
REFUSAL_CATEGORY, REFUSAL_EXPECT = "拒答", "未查到"  # fixed values of golden items


def _instant(text: Column, day_time: str, zone: str) -> Column:
    text = F.trim(text)
    full = F.when(text.rlike(DAY), F.concat(text, F.lit(f"T{day_time}"))).otherwise(text)
    return F.when(full.rlike(ZONE), full).otherwise(F.concat(full, F.lit(zone))).try_cast("timestamp")


def iso_instant(text: Column) -> Column:
    """An ISO date or time; without a zone it is UTC. Null if it can't be read."""
    return _instant(text, "00:00:00", "Z")


def log_bound(text: Column, end: bool = False) -> Column:
    """A bound of a log search: a bare day means its first or last moment, and
    times without a zone are those of UTC+8."""
    return _instant(text, "23:59:59.999999" if end else "00:00:00", "+08:00")


def _values(text: Column) -> Column:
    """A JSON object as a map of values with their types; null if it is none."""
    return F.from_json(text, "map<string,variant>")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def scalar_attributes(text: Column) -> Column:
    """A JSON object as a map of its scalar values that aren't null, as text;
    lists and objects are left out."""
    kept = F.map_filter(_values(text), lambda k, v: ~_kind(v).rlike("^(?:OBJECT|ARRAY|VOID$)"))
    return F.transform_values(kept, lambda k, v: F.variant_get(v, "$", "string"))


def patched(details: Column, patch: Column) -> Column:
    """A JSON object with the values of another one set, as JSON: values keep
    their types, nested ones are replaced whole, and a null in the patch sets
    null. Malformed or null objects count as empty."""
    of = lambda c: F.coalesce(_values(c), F.from_json(F.lit("{}"), "map<string,variant>"))
    return F.to_json(F.map_zip_with(of(details), of(patch), lambda k, a, b: F.coalesce(b, a)))


def json_lists(text: Column, keys: list[str]) -> Column:
    """The lists of an object in model text, each as clean distinct names: code
    fences are dropped, the whole text or else its widest braces are read. A key
    without a list gives an empty one, and so does text that is no object."""
    bare = F.regexp_replace(F.regexp_replace(T.strip(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    # a text that is an object as a whole is its own widest braces, so it is read once for both and all keys
    found = F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    none = F.array().cast("array<string>")
    own = lambda v, k: distinct_names(F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), none))
    return F.transform(F.array(found), lambda v: F.struct(*[own(v, k).alias(k) for k in keys]))[0]


def distinct_names(items: Column, longest: int = 20) -> Column:
    """Trimmed names without empty and overlong ones; of names that differ in
    case only the first stays. Lists are short: a query's entities."""
    kept = F.filter(T.clean_list(items), lambda x: F.length(x) <= longest)
    return F.aggregate(kept, F.array().cast("array<string>"), lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.concat(out, F.array(x))))


def json_flag(text: Column, key: str) -> Column:
    """A yes or no of a JSON object in model text: code fences are dropped, the
    whole text or else its widest braces are read, and words are understood."""
    bare = F.regexp_replace(F.regexp_replace(T.strip(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    found = F.lower(F.trim(F.coalesce(F.get_json_object(bare, f"$.{key}"), F.get_json_object(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), f"$.{key}"))))
    return F.when(found.isin("true", "1", "yes", "是"), True).when(found.isin("false", "0", "no", "否"), False)


def flat_content(content: Column) -> Column:
    """Chat content as text: a JSON list of strings and of objects with a text
    gives these by lines; anything else is the text itself; null is empty."""
    parts = F.from_json(content, "array<string>")
    texts = F.transform(parts, lambda p: F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p))
    joined = F.array_join(F.filter(texts, lambda t: t != ""), "\n")
    return F.coalesce(F.when(content.startswith("["), joined), content, F.lit(""))


def search_blob(*fields: Column, path: Column | None = None) -> Column:
    """What sparse search and reranking read of a chunk: its fields and section
    path, trimmed, each once, by lines."""
    all_fields = F.array(*fields) if path is None else F.concat(F.array(*fields), F.coalesce(path, F.array().cast("array<string>")))
    return F.array_join(F.array_distinct(T.clean_list(F.array_compact(all_fields))), "\n")


def query_terms(text: Column, synonyms: list[tuple[str, list[str]]], words=T.tokens) -> Column:
    """Each variant of a question and its words, each once."""
    terms = F.flatten(F.transform(T.expand_synonyms(text, synonyms), lambda v: F.concat(F.array(v), words(v))))
    return F.array_distinct(T.clean_list(terms))


def front_matter_split(text: Column) -> Column:
    """(body, license) of a text whose front matter may name a license."""
    head = F.regexp_extract(text, r"(?s)\A---(.*?)\n---", 1)
    has = text.rlike(r"(?s)\A---.*?\n---")
    line = F.regexp_replace(F.regexp_extract(head, r"(?m)^\s*license:[ \t]*(.*?)[ \t]*$", 1), r"""^["']+|["']+$""", "")
    return F.struct(
        F.when(has, F.regexp_replace(text, r"(?s)\A---.*?\n---\n*", "")).otherwise(text).alias("body"),
        F.when(has & head.rlike(r"(?m)^\s*license:"), line).otherwise(LICENSE).alias("license"),
    )


def triple_text(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat(subject, F.lit(" "), predicate, F.lit(" "), obj)


def entity_text(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(": "), name)


def context_line(name: Column, chunk_idx: Column, body: Column) -> Column:
    return F.concat(F.lit("[文献: "), F.coalesce(F.nullif(name, F.lit("")), F.lit("文献")), F.lit("#"), F.coalesce(chunk_idx, F.lit(0)).cast("string"), F.lit("] "), T.strip(F.coalesce(body, F.lit(""))))


def is_refusal_item(category: Column, expect: Column) -> Column:
    """Whether a golden item is to be refused."""
    none = F.array().cast("array<string>")
    return (F.trim(F.coalesce(category, F.lit(""))) == REFUSAL_CATEGORY) | F.exists(F.coalesce(expect, none), lambda x: F.trim(x) == REFUSAL_EXPECT)
