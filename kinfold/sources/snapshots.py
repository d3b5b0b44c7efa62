"""Tables that change together: a commit writes new files first and one manifest last, which is renamed into its place.

Readers take the files that a manifest names, so what a killed writer leaves behind is never seen, and all tables of a
commit change at once. Two writers can't both become the next version: the second one's rename fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.lineage import assign_fids


class Conflict(Exception):
    """Another writer has committed since the version that a commit was based on."""


class Store:
    """Versioned tables under one path, which any file system that Spark writes to can hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("versions").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        at, files = self._at(folder), self._files()
        return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []

    def versions(self) -> list[int]:
        """The committed versions, the first is 1."""
        return sorted(int(n.split(".")[0]) for n in self._names("versions") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """``version``, and the folders, rows and schema of each table; the last version unless one is given."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "tables": {}}
        if version not in known:
            raise ValueError(f"no version {version} of {self.path}")
        text = self.spark.read.text(f"{self.path}/versions/{version:010}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table in a version; None where it has never had any."""
        own = self.manifest(version)["tables"].get(table)
        return None if own is None else self.spark.read.schema(own["schema"]).parquet(*(f"{self.path}/data/{f}" for f in own["folders"]))

    def commit(self, rows: dict[str, DataFrame], based_on: int | None = None, check: Callable[[dict[str, DataFrame]], None] | None = None) -> int:
        """Adds rows to tables as one version and returns its number.

        ``check`` gets the rows as they were written, before anything is visible, and raises to keep them out. ``based_on``:
        the version that the rows were made from, else the last one; a later one there is a ``Conflict``.
        """
        before = self.manifest(based_on)
        after = {"version": before["version"] + 1, "tables": {k: dict(v) for k, v in before["tables"].items()}}
        written = {}
        for table, df in rows.items():
            folder = f"{table}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/data/{folder}")
            written[table] = self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{folder}")
            own = after["tables"].setdefault(table, {"folders": [], "rows": 0, "schema": _ddl(df)})
            if own["schema"] != _ddl(df):
                raise ValueError(f"{table} has the columns {own['schema']}")
            own["folders"], own["rows"] = [*own["folders"], folder], own["rows"] + written[table].count()
        if check:
            check(written)
        self._publish(after)
        return after["version"]

    def _publish(self, manifest: dict) -> None:
        files, hidden = self._files(), self._at(f"versions/.{uuid.uuid4().hex}")
        out = files.create(hidden, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        fs = self._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(hidden.toUri(), self._conf) if "://" in self.path else fs.FileContext.getFileContext(self._conf)
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:  # a rename that fails where there is such a version
            context.rename(files.makeQualified(hidden), files.makeQualified(self._at(f"versions/{manifest['version']:010}.json")), options)
        except Exception as e:
            files.delete(hidden, False)
            if "exist" in str(e).lower():
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise

    def leftovers(self) -> list[str]:
        """Folders of data that no version names: what writers left that were killed or are still at work."""
        named = {f for v in self.versions() for t in self.manifest(v)["tables"].values() for f in t["folders"]}
        return sorted(f for t in self._names("data") for f in (f"{t}/{x}" for x in self._names(f"data/{t}")) if f not in named)

    def vacuum(self) -> list[str]:
        """Deletes the leftovers; nobody may be writing."""
        gone = self.leftovers()
        for f in gone:
            self._files().delete(self._at(f"data/{f}"), True)
        return gone


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def add_functions(store: Store, found: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> int:
    """Adds the functions of ``found`` (fhash, body) that the store doesn't have, with ids and vectors, as one version.

    Ids go on after those that are there, in the order of the digests; of several bodies with one digest the least counts.
    ``embed`` makes vectors (fid, vec) of new functions (fid, body). Nothing is committed unless ids are without gaps and
    each new function has one vector. Without new functions the version stays as it is.
    """
    based_on = store.manifest()["version"]
    known = store.read("functions", based_on)
    bodies = found.where("fhash <> ''").groupBy("fhash").agg(F.min("body").alias("body"))
    fids = assign_fids(bodies.select("fhash"), None if known is None else known.select("fhash", "fid"))
    fids = fids if known is None else fids.join(known.select("fhash"), "fhash", "left_anti")
    new = fids.join(bodies, "fhash").select("fid", "fhash", "body").persist()
    try:
        if new.isEmpty():
            return based_on

        def check(rows: dict[str, DataFrame]) -> None:
            top = 0 if known is None else known.agg(F.max("fid")).first()[0]
            n, distinct, least, most = rows["functions"].agg(F.count("*"), F.countDistinct("fid"), F.min("fid"), F.max("fid")).first()
            if not n == distinct == most - top or least != top + 1:
                raise ValueError(f"ids {least} to {most} of {n} functions after {top}")
            odd = rows["vectors"].groupBy("fid").agg(F.count("*").alias("n")).join(rows["functions"].select("fid", F.lit(1).alias("f")), "fid", "full").where("f IS NULL OR n IS NULL OR n > 1")
            if not odd.isEmpty():
                raise ValueError("functions and vectors don't have the same ids")

        return store.commit({"functions": new, "vectors": embed(new.select("fid", "body"))}, based_on, check)
    finally:
        new.unpersist()


def build(store: Store, repos: DataFrame, builder: Callable[[DataFrame], DataFrame], batches: int = 1, again: DataFrame | None = None) -> int:
    """Builds what ``repos`` (repo) stand for and hasn't been built yet; returns how many repositories that were.

    ``builder`` makes rows (repo, ...) for some repositories. Each of the ``batches`` is one version: its rows and a ledger
    of the repositories that are finished, also those without rows. A run that was cut off goes on where it stopped; a
    repository in ``again`` (repo) is built anew, and its rows replace the old ones.
    """
    done = store.read("ledger")
    left = repos.select("repo").distinct()
    if done is not None:
        done = done.select("repo").distinct()
        left = left.join(done if again is None else done.join(again.select("repo"), "repo", "left_anti"), "repo", "left_anti")
    left = left.persist()
    total = left.count()
    for b in range(batches if total else 0):
        some = left.where(F.pmod(F.xxhash64("repo"), F.lit(batches)) == b)
        if not some.isEmpty():
            mark = F.lit(store.manifest()["version"] + 1).alias("built")
            rows = builder(some).join(some, "repo", "left_semi").withColumn("built", mark)
            store.commit({"rows": rows, "ledger": some.select("repo", mark)})
    left.unpersist()
    return total


def built(store: Store, version: int | None = None) -> DataFrame | None:
    """The rows of all repositories, each as it was built last."""
    rows, ledger = store.read("rows", version), store.read("ledger", version)
    if rows is None or ledger is None:
        return None
    last = ledger.groupBy("repo").agg(F.max("built").alias("built"))
    return rows.join(last, ["repo", "built"], "left_semi").drop("built")

