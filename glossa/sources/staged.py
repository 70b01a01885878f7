"""Several outputs that appear together: each version has folders of its own, and a numbered manifest that says where
everything is makes it the current one. A manifest is renamed into place, so readers see the old state or the new one;
a writer that fails leaves folders that no manifest names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.relational import sample_n

MANIFESTS = "_manifests"


class Store:
    """A folder with versions, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self.path(f"{self.root}/{MANIFESTS}")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"paths": {name: path}, "counts": {..}} of a version, by default the current one; empty before the first."""
        found = self.versions()
        if not found:
            return {"paths": {}, "counts": {}}
        stream = self.fs.open(self.path(f"{self.root}/{MANIFESTS}/{version or found[-1]:08d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def publish(self, manifest: dict) -> int:
        """Make a manifest the current one. Of two writers that began from the same version, the second fails."""
        version = (self.versions() or [0])[-1] + 1
        staged, final = self.path(f"{self.root}/{MANIFESTS}/.{uuid.uuid4().hex}"), self.path(f"{self.root}/{MANIFESTS}/{version:08d}.json")
        out = self.fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True, ensure_ascii=False).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(staged, final):
            self.fs.delete(staged, False)
            raise RuntimeError(f"version {version} has been published by another writer")
        return version

    def commit(self, outputs: dict[str, DataFrame], counts: dict | None = None, by: dict[str, list[str]] | None = None) -> int:
        """Write all outputs, partitioned as `by` says, then publish them with the counts; other outputs stay as they
        are. Fails as a whole: what was current stays so."""
        version, folder = self.manifest(), f"{self.root}/data/{uuid.uuid4().hex}"
        for name, df in outputs.items():
            df.write.partitionBy(*(by or {}).get(name, [])).parquet(f"{folder}/{name}")
        paths = version["paths"] | {name: f"{folder}/{name}" for name in outputs}
        return self.publish({"paths": paths, "counts": version["counts"] | (counts or {})})

    def read(self, name: str) -> DataFrame:
        paths = self.manifest()["paths"]
        if name not in paths:
            raise FileNotFoundError(f"no {name} in {self.root}")
        return self.spark.read.parquet(paths[name])

    def vacuum(self) -> int:
        """Delete folders that the current manifest does not name; how many. Not while others write or read."""
        folder = self.path(f"{self.root}/data")
        used = {p.rsplit("/", 2)[1] for p in self.manifest()["paths"].values()}
        gone = [s.getPath() for s in self.fs.listStatus(folder) if s.getPath().getName() not in used] if self.fs.exists(folder) else []
        for p in gone:
            self.fs.delete(p, True)
        return len(gone)


def save_corpus(store: Store, sentences: DataFrame, articles: DataFrame, counts: dict) -> int:
    """Sentences by variety, articles with how many sentences are left of each, and the rows left after every stage."""
    n = sentences.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    return store.commit({"sentences": sentences, "articles": articles.join(n, "article_id")}, counts, {"sentences": ["code"]})


def promote_and_sample(store: Store, name: str, by: str, keys: list[str], n: int = 100_000, seed: str = "42") -> DataFrame:
    """Keep the full output as `<name>_complete` and make a sample of at most n rows of each group the output of that
    name; (by, n_complete, n_sampled). The full rows are not copied; done again, the sample is drawn from them anew."""
    paths = store.manifest()["paths"]
    full = f"{name}_complete"
    rows = store.read(full if full in paths else name)
    sampled = f"{store.root}/data/{uuid.uuid4().hex}/{name}"
    sample_n(rows, [by], n, seed, keys).write.partitionBy(by).parquet(sampled)
    manifest = store.manifest()
    manifest["paths"] |= {full: manifest["paths"].get(full, manifest["paths"][name]), name: sampled}
    store.publish(manifest)
    count = lambda df, c: df.groupBy(by).agg(F.count(F.lit(1)).alias(c))
    return count(store.read(full), "n_complete").join(count(store.read(name), "n_sampled"), by, "left")
