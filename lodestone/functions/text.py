"""Text functions: columns in, columns out. Nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\x09-\x0D\x20]"

# Simplified characters and the traditional ones at the same places.
SIMPLIFIED = "医药汤气证伤阳阴经脉脏腑风湿热寒症与为无发补泻体疗参么黄"
TRADITIONAL = "醫藥湯氣證傷陽陰經脈臟腑風濕熱寒癥與為無發補瀉體療參麼黃"

# Patterns of personal data.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
IDENTITY = r"(?<!\d)\d{15}(?:\d{2}[0-9Xx])?(?!\d)"
REDACTED = "[REDACTED]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def windows(text: Column, size: int = 400, overlap: int = 80) -> Column:
    """Fixed windows of the stripped text; the last one ends with it. Empty
    texts have none."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    overlap = min(max(overlap, 0), size - 1)
    step = size - overlap
    held = -(-size // step)  # steps that a window reaches over

    def joined(body: Column) -> Column:
        # cut into steps once: substring would count from the start of the text for each window
        steps = F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
        count = F.greatest(F.lit(1), F.ceil((F.length(body) - overlap) / step)).cast("int")
        return F.transform(F.array(F.struct(steps.alias("steps"), count.alias("n"))), lambda s: F.transform(F.slice(s["steps"], 1, s["n"]), lambda part, i: F.substring(F.array_join(F.slice(s["steps"], i + 1, F.lit(held)), ""), 1, size)))[0]

    return F.transform(F.array(strip(text)), lambda body: F.when(F.length(body) > 0, joined(body)).otherwise(F.array().cast("array<string>")))[0]


def clean_markdown(text: Column) -> Column:
    """LF line ends, no leading front matter, at most one blank line in a row."""
    text = F.regexp_replace(text, r"\r\n", "\n")
    text = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def to_traditional(text: Column) -> Column:
    return F.translate(text, SIMPLIFIED, TRADITIONAL)


def to_simplified(text: Column) -> Column:
    return F.translate(text, TRADITIONAL, SIMPLIFIED)


def script_variants(text: Column) -> Column:
    return F.array_distinct(F.array(text, to_simplified(text), to_traditional(text)))


def expand_synonyms(text: Column, synonyms: list[tuple[str, list[str]]]) -> Column:
    """The script variants, then each variant with each needle replaced."""
    variants = script_variants(text)
    found = [variants]
    for needle, others in synonyms:
        for other in others:
            found.append(_replaced(variants, F.lit(needle), F.lit(other)))
    return F.array_distinct(F.concat(*found))


def _replaced(variants: Column, needle: Column, other: Column) -> Column:
    return F.transform(F.filter(variants, lambda v: F.contains(v, needle)), lambda v: F.replace(v, needle, other))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{BLANK}+", " "))


def clip(text: Column, size: int = 80) -> Column:
    """White space collapsed, an ellipsis after `size` characters."""
    flat = collapse(text)
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def title_of(question: Column, size: int = 20, default: str = "新对话") -> Column:
    flat = collapse(F.coalesce(question, F.lit("")))
    return F.when(flat == "", default).when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def truncate(text: Column, size: int = 2000, marker: str = "...[truncated]") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(marker))).otherwise(text)


def redact(text: Column) -> Column:
    """Phone numbers, 15 and 18 digit identities and e-mail addresses, in this order."""
    for pattern in (PHONE, IDENTITY, EMAIL):
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def escape_like(text: Column) -> Column:
    for c in ("\\", "%", "_"):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def safe_file_name(name: Column, size: int = 80) -> Column:
    """The last path part with illegal characters as underscores."""
    last = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)\z", 1), r'[<>:"|?*\x00-\x1f]', "_")
    return F.when(last.isin("", ".", ".."), "unnamed").otherwise(F.substring(last, 1, size))


def is_safe_name(name: Column) -> Column:
    return (name != "") & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\\")) & ~F.contains(name, F.lit(".."))


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words; other tokenizers fit wherever arrays of strings do."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1))


def bigrams(text: Column) -> Column:
    """Distinct character pairs without white space; one character is itself."""
    # cut into characters once: substring would count from the start of the text for each pair
    one = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{BLANK}+", ""), F.lit("(?s)."), F.lit(0))
    two = lambda c: F.transform(F.arrays_zip(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(1))).alias("a"), F.slice(c, 2, F.size(c)).alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit(""))))
    return F.transform(F.array(one), lambda c: F.array_distinct(two(c)))[0]


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def covers(a: Column, b: Column, least: float = 0.7) -> Column:
    """Either text holds the other, or their character sets are alike."""
    return F.contains(a, b) | F.contains(b, a) | (jaccard(characters(a), characters(b)) >= least)


def hit_ratio(text: Column, needles: list[str]) -> Column:
    return F.size(present(text, needles)) / F.lit(max(1, len(needles)))


def present(text: Column, terms: list[str]) -> Column:
    """Dictionary terms found in the text, in dictionary order."""
    return F.filter(F.lit(terms), lambda t: F.contains(text, t))


def reference_span(text: Column, needle: str, before: int = 24, after: int = 160) -> Column:
    """From `before` ahead of the first needle to `after` past its start; else the start."""
    at = F.locate(needle, text)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at + after - start)).otherwise(F.substring(text, 1, after))


def clean_list(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x != "")


def json_array(text: Column, ddl: str) -> Column:
    """A JSON array that is the whole text, else the widest bracketed part."""
    return F.coalesce(F.from_json(text, ddl), F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), ddl))


def fingerprint(*parts: Column) -> Column:
    return F.sha1(F.concat_ws(":", *parts).cast("binary"))
