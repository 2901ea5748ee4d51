"""JSON whose shape drifts: arrays, wrapped lists, single objects, and rows that
are none of these, kept apart with the reason.

Texts are read as `variant`, so one pass parses them whatever fields they have,
and fields are taken out by path and type afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIST, WRAPPED, OBJECT = "list", "wrapped", "object"
NOT_JSON, EMPTY, NOT_AN_OBJECT, WRONG_KIND = "not_json", "empty", "not_an_object", "wrong_kind"


def read_texts(spark: SparkSession, folder: str, suffix: str = "json") -> DataFrame:
    """(id, body) of the files below a folder, whole, by file name without its suffix."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)\.{suffix}$", 1).alias("id"), F.col("value").alias("body"))


def split_records(texts: DataFrame, wrappers: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of texts (id, body).

    A list gives its items, an object that has one of `wrappers` as a list gives
    the items of the first such, any other object is one item. Records are (id,
    shape, place, record), places from 0; items that aren't objects, and texts
    that are no JSON, empty or a bare value, go to the quarantine (id, place,
    reason, body), so each text and item is in one of the two.
    """
    parsed = texts.withColumn("v", F.try_parse_json("body"))
    kind = F.schema_of_variant("v")
    inner = F.coalesce(*[F.try_variant_get("v", f"$.{w}", "array<variant>") for w in wrappers]) if wrappers else F.lit(None).cast("array<variant>")
    is_list = kind.startswith("ARRAY")
    shape = F.when(is_list, LIST).when(inner.isNotNull(), WRAPPED).when(kind.startswith("OBJECT"), OBJECT)
    items = F.when(is_list, F.try_variant_get("v", "$", "array<variant>")).when(inner.isNotNull(), inner).when(kind.startswith("OBJECT"), F.array("v"))
    reason = F.when(F.trim(F.coalesce("body", F.lit(""))) == "", EMPTY).when(F.col("v").isNull(), NOT_JSON).when(shape.isNull(), NOT_AN_OBJECT)
    shaped = parsed.select("id", "body", reason.alias("reason"), shape.alias("shape"), items.alias("items"))
    each = shaped.filter("reason IS NULL").select("id", "shape", F.posexplode("items").alias("place", "record"))
    sound = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    bad = shaped.filter("reason IS NOT NULL").select("id", F.lit(None).cast("int").alias("place"), "reason", "body")
    odd = each.filter(~sound).select("id", "place", F.lit(NOT_AN_OBJECT).alias("reason"), F.to_json("record").alias("body"))
    return each.filter(sound), bad.unionByName(odd)


def fields(records: DataFrame, wanted: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of records (id, place, record): fields by path with
    their types, as `{"name": "string", "meta.size": "long"}`. A field that is
    absent or null is null; a record with a field that can't be of its type goes
    to the quarantine whole. Columns are named by the last part of their path."""
    paths = {p: p.split(".")[-1] for p in wanted}
    if len(set(paths.values())) < len(paths):
        raise ValueError("two paths end in one name")
    present = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get("record", f"$.{p}", "variant")), F.lit("VOID")) != "VOID"
    value = lambda p: F.try_variant_get("record", f"$.{p}", wanted[p])
    wrong = F.array_compact(F.array(*[F.when(present(p) & value(p).isNull(), p) for p in wanted]))
    judged = records.select("id", "place", "record", wrong.alias("wrong"), *[value(p).alias(f"__{n}") for p, n in paths.items()])
    rows = judged.filter(F.size("wrong") == 0).select("id", "place", *[F.col(f"__{n}").alias(n) for n in paths.values()])
    bad = judged.filter(F.size("wrong") > 0).select("id", "place", F.concat(F.lit(f"{WRONG_KIND}: "), F.array_join("wrong", ",")).alias("reason"), F.to_json("record").alias("body"))
    return rows, bad


def wiki_text(body: Column) -> Column:
    """(title, html) of a wiki interface's answer {parse: {title, text}}, whose
    text is an object with key `*` in older versions. Null where it has none."""
    v = F.try_parse_json(body)
    plain = F.when(F.schema_of_variant(F.try_variant_get(v, "$.parse.text", "variant")) == "STRING", F.try_variant_get(v, "$.parse.text", "string"))
    html = F.coalesce(plain, F.try_variant_get(v, "$.parse.text['*']", "string"))
    return F.struct(F.trim(F.coalesce(F.try_variant_get(v, "$.parse.title", "string"), F.lit(""))).alias("title"), F.nullif(html, F.lit("")).alias("html"))


def archive_text(body: Column) -> Column:
    """(title, text, error) of a text archive's answer {title, fulltext}: the
    paragraphs, or the one text, joined by blank lines, empty ones left out.
    `error` is `login` where it asks for one, or shows parts without a text, and
    `no_text` or `not_json` where there is nothing to read."""
    v = F.try_parse_json(body)
    text = lambda path: F.try_variant_get(v, path, "string")
    some = lambda path: ~F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID")).isin("VOID", "ARRAY<VOID>")
    parts = F.coalesce(F.try_variant_get(v, "$.fulltext", "array<string>"), F.when(some("$.fulltext"), F.array(text("$.fulltext"))))
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    said = F.coalesce(*[F.nullif(text(p), F.lit("")) for p in ("$.error", "$.err", "$.code")], F.lit(""))
    has = F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0
    login = F.contains(F.upper(said), F.lit("AUTH")) | (some("$.subsections") & ~has)
    error = F.when(v.isNull(), NOT_JSON).when(login, "login").when(~has, "no_text")
    return F.struct(F.trim(F.coalesce(text("$.title"), F.lit(""))).alias("title"), F.when(error.isNull(), F.array_join(kept, "\n\n")).alias("text"), error.alias("error"))
