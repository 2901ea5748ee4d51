"""Filters, access rules, keyed folds and reports over registry-like tables.

Tables without row-level updates are append logs; the current state is the
latest row of each key. `now`, users and limits are parameters, never clocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import escape_like


def all_of(*terms: Column | None) -> Column:
    """The conjunction of the terms that are given."""
    return reduce(lambda a, b: a & b, [t for t in terms if t is not None], F.lit(True))


def like_any(column: str, keyword: str | None) -> Column | None:
    return F.col(column).like(f"%{_escaped(keyword)}%") if keyword else None


def _escaped(keyword: str) -> str:
    return keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_column(text: Column, keyword: Column) -> Column:
    return F.like(text, F.concat(F.lit("%"), escape_like(keyword), F.lit("%")))


def between(column: str, start=None, end=None) -> Column | None:
    if start and end and start > end:
        raise ValueError("start lies after end")
    return all_of(F.col(column) >= F.lit(start) if start else None, F.col(column) <= F.lit(end) if end else None)


def page(df: DataFrame, order: list, number: int = 1, size: int = 20) -> DataFrame:
    """A page of ordered rows; sizes go from 1 to 200."""
    size = min(max(size, 1), 200)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def acl_ok(dept: Column, roles: Column, user_dept: Column, user_role: Column) -> Column:
    """Administrators see all; a document's department must match if it has
    one; then its role list, if it has one. Nulls count as empty, and whatever
    can't be decided is denied."""
    dept, roles = F.coalesce(dept, F.lit("")), F.coalesce(roles, F.lit(""))
    names = F.filter(F.transform(F.split(roles, ","), lambda r: F.trim(r)), lambda r: r != "")
    rest = ((dept == "") | dept.eqNullSafe(user_dept)) & ((F.size(names) == 0) | F.coalesce(F.array_contains(names, user_role), F.lit(False)))
    return F.coalesce(user_role == "admin", F.lit(False)) | rest


def visible(owner: Column, user: str, role: str) -> Column:
    return F.lit(True) if role == "admin" or not user else owner == user


def latest(log: DataFrame, key: list[str], order: Column, deleted: Column | None = None) -> DataFrame:
    """Last write wins: the row of each key with the largest `order`, without
    keys whose last row is a tombstone."""
    columns = [c for c in log.columns if c not in key]
    flags = [deleted.alias("__deleted")] if deleted is not None else []
    last = log.groupBy(*key).agg(F.max_by(F.struct(*columns, *flags), order).alias("row"))
    if deleted is not None:
        last = last.filter(~F.coalesce(F.col("row.__deleted"), F.lit(False)))
    return last.select(*key, *[F.col(f"row.{c}").alias(c) for c in columns])


def upsert_counts(existing: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """`existing` (key, n) with one more for each row of `found` and new keys added."""
    return existing.select(key, "n").unionByName(found.select(key, F.lit(1).cast("bigint").alias("n"))).groupBy(key).agg(F.sum("n").alias("n"))


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def cascade(tables: dict[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    return {name: without(df, keys, key) for name, df in tables.items()}


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Parents that come anew lose all their old rows."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def first_per(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY {', '.join(order)})")
    return df.withColumn("place", rank).filter(F.col("place") <= n)


def distinct_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the first by `order`."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*key, *[F.col(f"row.{c}").alias(c) for c in rest])


def status_counts(df: DataFrame, column: str, statuses: list[str]) -> DataFrame:
    """Counts of all the statuses, zeros included."""
    wanted = df.sparkSession.createDataFrame([(s,) for s in statuses], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return wanted.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def force_sample(ms: Column, retries: Column, routed: Column, query: Column, answer: Column) -> Column:
    """Why a trace is sampled in any case, else null."""
    return F.when(ms > 30_000, "slow").when(retries > 0, "retry").when(routed & (query == ""), "no_query").when(answer == "", "empty_answer")


def sampled(key: Column, rate: float) -> Column:
    """A share of keys, the same ones on every run."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(rate * 1_000_000)


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * 1.0 + tokens_out / 1e6 * 3.0
