"""A keyed table under a manifest: what the newest manifest names is the table, whatever else lies in its folder.

A batch writes its rows into a folder of its own and then one small manifest, which appears under its name at once and
whole. A crash before that leaves the table as it was; a batch that runs again after it changes nothing. Rows are dealt
out in buckets by key, and a bucket is a list of folders of which the newest row of a key counts. A bucket of more than
``most`` folders is rewritten as one, and folders that no recent manifest names are removed.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.merge import newest

_BATCH = "__batch"


class CommitConflict(RuntimeError):
    """Another writer has committed meanwhile."""


class ManifestTable:
    """Rows of ``schema`` by ``key``, the newest ``rev`` of each; buckets are fixed when the table begins.

    keep manifests stay readable, so that a reader that has opened one isn't robbed of its folders by the next commits.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, rev: str, buckets: int = 16, most: int = 4, keep: int = 2):
        self.spark, self.path, self.schema, self.key, self.rev = spark, path.rstrip("/"), schema, key, rev
        self._most, self._keep = most, keep
        held = self.current()
        self.buckets = held["of"] if held else buckets

    # --- files

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    @property
    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names("_manifests") if (m := re.fullmatch(r"(\d+)\.json", n)))

    def current(self) -> dict | None:
        """The newest manifest: version, batch (the last one in it), of (buckets), folders by bucket; None before the first commit."""
        versions = self.versions()
        return self._load(versions[-1]) if versions else None

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._at("_manifests", f"{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Write under a name that nobody reads, then rename: a manifest is there whole or not at all."""
        draft, final = self._at("_manifests", f".{uuid.uuid4().hex}"), self._at("_manifests", f"{manifest['version']}.json")
        out = self._fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {manifest['version']} is there already")

    def _clean(self) -> None:
        """Remove old manifests, and folders that no kept one names, those of crashed batches included."""
        versions = self.versions()
        for old in versions[: -self._keep]:
            self._fs.delete(self._at("_manifests", f"{old}.json"), False)
        named = {f for v in versions[-self._keep :] for folders in self._load(v)["folders"].values() for f in folders}
        for batch in self._names("data"):
            own = self._names("data", batch)
            dead = [n for n in own if n.startswith("bucket=") and f"data/{batch}/{n}" not in named]
            if len(dead) == sum(n.startswith("bucket=") for n in own):
                self._fs.delete(self._at("data", batch), True)
            else:
                for n in dead:
                    self._fs.delete(self._at("data", batch, n), True)

    # --- rows

    def _rows(self, folders: list[str]) -> DataFrame:
        schema = f"{self.schema}, {_BATCH} long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row a key: the largest revision, a null one last; of equal ones that of the later batch."""
        return newest(rows, [self.key], F.desc_nulls_last(self.rev), F.desc(_BATCH))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as the newest manifest, or a kept older one, names it."""
        held = self.current() if version is None else self._load(version)
        folders = [f for own in held["folders"].values() for f in own] if held else []
        return self._newest(self._rows(folders)).drop(_BATCH)

    def _write(self, rows: DataFrame, name: str) -> dict[str, str]:
        """Folders by bucket; large buckets are several files, small ones one."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        folder = f"data/{name}-{uuid.uuid4().hex[:12]}"
        rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return {m[1]: f"{folder}/{n}" for n in self._names(folder) if (m := re.fullmatch(r"bucket=(\d+)", n))}

    def apply(self, rows: DataFrame, batch: int) -> bool:
        """Merge rows as batch number ``batch`` and commit; False, and nothing done, if that batch is in already.

        Of several rows of a key the largest revision comes in (then the largest of the other columns, so that a rerun
        chooses alike); a null revision replaces nothing but another null.
        """
        held = self.current() or {"version": -1, "batch": None, "of": self.buckets, "folders": {}}
        if held["batch"] is not None and batch <= held["batch"]:
            return False
        columns = self._rows([]).columns[:-1]
        rows = rows.select(columns)
        others = [F.desc(c) for c in columns if c not in (self.key, self.rev)]
        fresh = newest(rows, [self.key], F.desc_nulls_last(self.rev), *others).withColumn(_BATCH, F.lit(batch).cast("long"))
        folders = {bucket: list(own) for bucket, own in held["folders"].items()}
        for bucket, folder in self._write(fresh, f"{batch}").items():
            folders.setdefault(bucket, []).append(folder)
        crowded = {bucket: own for bucket, own in folders.items() if len(own) > self._most}
        if crowded:
            whole = self._newest(self._rows([f for own in crowded.values() for f in own]))
            folders |= {bucket: [folder] for bucket, folder in self._write(whole, f"{batch}-whole").items()}
        self._commit({"version": held["version"] + 1, "batch": batch, "of": self.buckets, "folders": folders})
        self._clean()
        return True
