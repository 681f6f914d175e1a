"""Generations of cached tables: full builds, increments, pruning and clearing behind one manifest.

A generation is a folder of Parquet tables. Manifests are numbered and never replaced: each
names the tables of a generation and is made, if its number is not there yet, once they are
complete. Readers follow the newest one that is whole, so that a failed write leaves the last
generation in place; of two writers that began from one manifest the second one fails. All
file operations go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, str]]:
        """Numbers and names of the manifests, newest first, broken ones too."""
        found = self._fs.globStatus(self._path(f"{self.root}/MANIFEST-*.json"))
        names = [x.getPath().toString() for x in found or ()]
        return sorted(((int(re.search(r"MANIFEST-(\d+)\.json$", n)[1]), n) for n in names), reverse=True)

    def manifest(self) -> dict | None:
        """The newest whole manifest, or None if nothing was built or its version is another one."""
        for _, name in self._manifests():
            text = "".join(r.value for r in self.spark.read.text(name, wholetext=True).collect())
            try:
                found = json.loads(text)
            except json.JSONDecodeError:
                continue  # its writer was lost
            return found if found["schema"] == SCHEMA_VERSION else None
        return None

    def table(self, name: str) -> DataFrame:
        current = self.manifest()
        if current is None:
            raise LookupError("nothing is built here")
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in current["tables"][name]])

    def _next(self) -> int:
        """The number that a change begun now is to take."""
        found = self._manifests()
        return found[0][0] + 1 if found else 1

    def _publish(self, number: int, tables: dict[str, list[str]], meta: dict) -> dict:
        body = json.dumps({"schema": SCHEMA_VERSION, "generation": uuid.uuid4().hex, "tables": tables, **meta})
        name = self._path(f"{self.root}/MANIFEST-{number:012d}.json")
        if self._fs.exists(name):
            raise FileExistsError("another writer has changed the store")
        out = self._fs.create(name, False)  # fails if it was made meanwhile
        out.write(bytearray(body.encode()))
        out.close()
        return json.loads(body)

    def _write(self, tables: dict[str, DataFrame]) -> dict[str, list[str]]:
        home = f"gen-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{home}/{name}")
        return {name: [f"{home}/{name}"] for name in tables}

    def build(self, tables: dict[str, DataFrame], **meta) -> dict:
        """A new generation from scratch; the last one stays until it is cleared."""
        number = self._next()
        return self._publish(number, self._write(tables), meta)

    def append(self, tables: dict[str, DataFrame], key: str = "oid", **meta) -> dict:
        """Rows of commits that are not cached yet, as further folders of each table. Fresh tables change nothing."""
        number, current = self._next(), self.manifest()
        if current is None:
            return self.build(tables, **meta)
        have = self.table("commits").select(key)
        new = {n: d.join(have, key, "left_anti") for n, d in tables.items()}
        if new["commits"].isEmpty():
            return current
        added = self._write(new)
        return self._publish(number, {n: [*current["tables"].get(n, []), *added.get(n, [])] for n in {**current["tables"], **added}}, {**{k: v for k, v in current.items() if k not in ("schema", "generation", "tables")}, **meta})

    def prune(self, missing: DataFrame, key: str = "oid", *, dry_run: bool = False) -> dict[str, int]:
        """Rewrite all tables without the commits ``missing(oid)``; counts of rows that go (or would)."""
        number, current = self._next(), self.manifest()
        if current is None:
            return {}
        gone = missing.select(key).distinct()
        counts = {n: self.table(n).join(gone, key, "left_semi").count() for n in current["tables"]}
        if not dry_run and any(counts.values()):
            kept = {n: self.table(n).join(gone, key, "left_anti") for n in current["tables"]}
            self._publish(number, self._write(kept), {k: v for k, v in current.items() if k not in ("schema", "generation", "tables")})
        return counts

    def clear(self, *, dry_run: bool = False) -> int:
        """Delete everything; the number of files that go (or would)."""
        root = self._path(self.root)
        if not self._fs.exists(root):
            return 0
        n = self._fs.getContentSummary(root).getFileCount()
        if not dry_run:
            self._fs.delete(root, True)
        return int(n)

    def check(self) -> list[str]:
        """What is wrong with the current generation; nothing if it is sound."""
        c, p = self.table("commits"), self.table("parents")
        found = []
        if c.groupBy("oid").count().where("count > 1").limit(1).count():
            found.append("a commit is cached twice")
        if p.join(c.select("oid"), "oid", "left_anti").limit(1).count():
            found.append("an edge has no commit")
        return found


def index(spark: SparkSession, repo: str, root: str, tips: str = "HEAD") -> dict:
    """Read a Git repository into a store: all of it at first, only new commits later."""
    from palimpsest.sources.git import graph, register

    register(spark)
    store = Store(spark, root)
    current = store.manifest()
    known = ""
    if current is not None:
        want = graph(repo, tips.split())
        have = {r.oid for r in store.table("commits").join(spark.createDataFrame([(o,) for o in want], "oid string"), "oid", "left_semi").collect()}
        if len(have) == len(want):
            return current
        known = " ".join(have)
    read = lambda t: spark.read.format("githistory").option("path", repo).option("table", t).option("tips", tips).option("known", known).load()
    return store.append({t: read(t) for t in ("commits", "parents", "changes", "hunks")}, tips=tips)
