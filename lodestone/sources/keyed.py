"""A keyed table on shared storage: merges, point reads, patches and deletes.

Rows lie in buckets of their key. A batch of changes is folded to one row per
key and written as a new folder of the buckets that it touches; a small commit
file then makes it count. Reading folds a bucket's base with the changes
committed since; compaction writes touched buckets anew and commits them as
their base. What isn't committed doesn't count, so a run that dies after any
step can be run again: a batch whose name is committed is skipped, and an
unfinished folder is never read. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

PUT, PATCH, DELETE = "put", "patch", "delete"
MARKS = ["__reset", "__alive"]  # of a change: forgets what was before; leaves a row


class Bucket(NamedTuple):
    base: str | None
    changes: list[tuple[int, str]]  # commit and folder, in order


def fold(changes: DataFrame, key: list[str], order: str, columns: list[str], attributes: str | None = None) -> DataFrame:
    """One change for each key, as if all had come in `order`: later values
    that aren't null win, attributes are united entry by entry, a put or delete
    forgets what was before it. Every grouping keeps maxima only, entries have
    keys of their own, so a key of very many changes is combined within tasks."""
    at = F.col(order)
    last = lambda c: F.max(F.when(F.col("__alive") & F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))
    marks = [F.max(F.when(F.col("__reset"), at)).alias("__r"), F.max(F.when(F.col("__alive"), at)).alias("__a")]
    plain = [last(c).alias(f"__last_{c}") for c in columns]
    found = changes.groupBy(*key).agg(*marks, *plain)
    since = lambda x, at="at": F.coalesce(x[at] >= F.col("__r"), x.isNotNull())
    if attributes:
        entries = changes.filter("__alive").select(*key, at.alias("__at"), F.explode(attributes).alias("__k", "__v"))
        entries = entries.filter("__v IS NOT NULL").groupBy(*key, "__k").agg(F.max(F.struct("__at", F.col("__v").alias("v"))).alias("__e"))
        lists = entries.groupBy(*key).agg(F.collect_list(F.struct("__k", "__e")).alias("__entries"))
        found = found.join(lists, key, "left")
        kept = F.filter("__entries", lambda x: since(x["__e"], "__at"))
        plain_map = F.map_from_entries(F.transform(kept, lambda x: F.struct(x["__k"], x["__e"]["v"])))
        found = found.withColumn(attributes, plain_map)
    values = [F.when(since(F.col(f"__last_{c}")), F.col(f"__last_{c}.v")).alias(c) for c in columns]
    alive = F.coalesce(F.col("__a") >= F.col("__r"), F.col("__a").isNotNull())
    return found.select(*key, *values, *([attributes] if attributes else []), F.col("__r").isNotNull().alias("__reset"), alive.alias("__alive"))


class KeyedTable:
    """Rows of `schema` by `key`, none of whose columns may be null; one map
    column of strings may hold attributes. The schema and the number of buckets
    stay those of the first commit."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        maps = [f.name for f in schema if isinstance(f.dataType, MapType)]
        if len(maps) > 1:
            raise ValueError("one map column at most")
        self.attributes = maps[0] if maps else None
        self.columns = [f.name for f in schema if f.name not in key and f.name != self.attributes]
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Commits

    def commits(self) -> list[dict]:
        """All commits in order; small files, one a batch."""
        folder = self._Path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        files = sorted(f.getPath().getName() for f in self._fs.listStatus(folder))
        return [json.loads(self._read(f"{self.path}/commits/{n}")) for n in files if n.endswith(".json")]

    def committed(self) -> dict[str, dict]:
        """The last commit of each named batch."""
        return {c["batch"]: c for c in self.commits() if c["batch"]}

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._Path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, **what) -> None:
        n = max((c["n"] for c in self.commits()), default=0) + 1
        begun, done = self._Path(f"{self.path}/commits/.{n:012d}.begun"), self._Path(f"{self.path}/commits/{n:012d}.json")
        out = self._fs.create(begun, True)
        out.write(bytearray(json.dumps(what | {"n": n}).encode()))
        out.close()
        if not self._fs.rename(begun, done):
            raise RuntimeError(f"commit {n} exists: another writer was faster")

    def state(self) -> dict[int, Bucket]:
        """Base and changes of each bucket, as committed."""
        base: dict[int, tuple[int, str]] = {}
        changes: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for c in self.commits():
            for b in c["buckets"]:
                if c["kind"] == "base":
                    base[b] = c["n"], c["folder"]
                    changes[b] = [x for x in changes[b] if x[0] > c["upto"]]
                else:
                    changes[b].append((c["n"], c["folder"]))
        return {b: Bucket(base.get(b, (0, None))[1], changes[b]) for b in sorted({*base, *changes})}

    # Writing

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> list[int]:
        """Write rows by bucket, sorted by key, and tell which buckets there are."""
        placed = rows.withColumn("__bucket", self.bucket()).repartition("__bucket").sortWithinPartitions("__bucket", *self.key)
        placed.write.partitionBy("__bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._Path(f"{self.path}/{folder}"))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("__bucket="))

    def merge(self, batch: str, changes: DataFrame, kind: Column | str = PATCH, order: str | None = None) -> bool:
        """Commit a batch of changes: rows of the table's columns, each a put, a
        patch (nulls leave values as they are, attributes are united) or a
        delete, by `order` where a key has several. False, and nothing is done,
        if this batch is committed."""
        if batch in self.committed():
            return False
        kind = F.lit(kind) if isinstance(kind, str) else kind
        at = F.col(order) if order else F.lit(0)
        rows = changes.withColumns({"__reset": kind != PATCH, "__alive": kind != DELETE, "__order": at})
        for f in self.schema:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        folder = f"changes/{uuid.uuid4().hex}"
        buckets = self._write(fold(rows, self.key, "__order", self.columns, self.attributes), folder)
        self._commit(kind="changes", batch=batch, folder=folder, buckets=buckets)
        return True

    def compact(self, changed: int = 1) -> list[int]:
        """Write the buckets with `changed` or more folders of changes anew."""
        state = {b: s for b, s in self.state().items() if len(s.changes) >= changed}
        if not state:
            return []
        upto = max(n for s in state.values() for n, _ in s.changes)
        folder = f"base/{uuid.uuid4().hex}"
        self._write(self._folded(state), folder)
        self._commit(kind="base", batch=None, folder=folder, buckets=sorted(state), upto=upto)
        return sorted(state)

    def vacuum(self) -> int:
        """Remove folders that no commit makes current; how many."""
        live = {f for s in self.state().values() for f in (s.base, *(f for _, f in s.changes)) if f}
        old = [f.getPath() for kind in ("base", "changes") if self._fs.exists(self._Path(f"{self.path}/{kind}")) for f in self._fs.listStatus(self._Path(f"{self.path}/{kind}"))]
        gone = [p for p in old if f"{p.getParent().getName()}/{p.getName()}" not in live]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    # Reading

    def _stored(self, folder: str, buckets: list[int], marks: bool) -> DataFrame | None:
        paths = [p for b in buckets if self._fs.exists(self._Path(p := f"{self.path}/{folder}/__bucket={b}"))]
        if not paths:
            return None
        own = StructType([*self.schema, *StructType.fromDDL("__reset boolean, __alive boolean")]) if marks else self.schema
        return self.spark.read.schema(own).parquet(*paths)

    def _folded(self, state: dict[int, Bucket]) -> DataFrame:
        bases, changes = defaultdict(list), defaultdict(list)
        for b, s in state.items():
            if s.base:
                bases[s.base].append(b)
            for n, folder in s.changes:
                changes[n, folder].append(b)
        columns = [f.name for f in self.schema]
        logged = [df.withColumn("__n", F.lit(n)) for (n, folder), own in changes.items() if (df := self._stored(folder, own, True)) is not None]
        calm = [b for b, s in state.items() if not s.changes]
        out = []
        for folder, own in bases.items():
            quiet, busy = [b for b in own if b in calm], [b for b in own if b not in calm]
            if quiet and (df := self._stored(folder, quiet, False)) is not None:
                out.append(df)
            if busy and (df := self._stored(folder, busy, False)) is not None:
                logged.append(df.withColumns({"__reset": F.lit(True), "__alive": F.lit(True), "__n": F.lit(0)}))
        if logged:
            both = logged[0]
            for df in logged[1:]:
                both = both.unionByName(df)
            out.append(fold(both, self.key, "__n", self.columns, self.attributes).filter("__alive").select(*columns))
        if not out:
            return self.spark.createDataFrame([], self.schema)
        rows = out[0].select(*columns)
        for df in out[1:]:
            rows = rows.unionByName(df.select(*columns))
        return rows

    def read(self) -> DataFrame:
        """All rows as committed."""
        return self._folded(self.state())

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of `keys`, from their buckets alone: their numbers, at most
        as many as there are buckets, pass through the driver."""
        keys = keys.select(*self.key).distinct()
        wanted = {r[0] for r in keys.select(self.bucket()).distinct().collect()}
        return self._folded({b: s for b, s in self.state().items() if b in wanted}).join(keys, self.key, "left_semi").select(*[f.name for f in self.schema])
