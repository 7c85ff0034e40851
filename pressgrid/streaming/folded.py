"""A keyed table that grows by batches: a snapshot by buckets, and a log of the batches since.

A batch only writes its own folded rows. Every few batches the log is folded
into the buckets it touches, and a manifest names the files that make up the new
snapshot. Reading opens one file set per bucket and the few batches since, however
many batches there were. Everything is written under the number of its batch, so a repeated batch or fold
replaces what it wrote before and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.sources.folders import numbered, remove


@dataclass
class FoldedTable:
    """`merge` folds rows of one key to one; it may be applied to its own results (max_by, sum of sums)."""

    spark: SparkSession
    path: str
    key: str
    merge: Callable[[DataFrame], DataFrame]
    buckets: int = 16
    fold_every: int = 10

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Store one batch; on every `fold_every`-th one the log is folded."""
        if batch_id > self.version():  # a repeated batch that is in the snapshot already adds nothing
            self.merge(batch).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
        if (batch_id + 1) % self.fold_every == 0:
            self.fold(batch_id)

    def version(self) -> int:
        """The last batch in the snapshot, -1 without one."""
        return max(numbered(self.spark, f"{self.path}/manifest", "version"), default=-1)

    def _manifest(self, version: int) -> dict[int, int]:
        """Bucket -> the version that wrote it; one row per bucket."""
        if version < 0:
            return {}
        return {r["bucket"]: r["written"] for r in self.spark.read.parquet(f"{self.path}/manifest/version={version}").collect()}

    def _snapshot(self, manifest: dict[int, int], buckets: list[int]) -> DataFrame | None:
        paths = [f"{self.path}/snapshot/version={manifest[b]}/bucket={b}" for b in buckets if b in manifest]
        return self.spark.read.parquet(*paths) if paths else None

    def _log(self, after: int, upto: int | None = None) -> DataFrame | None:
        since = [n for n in numbered(self.spark, f"{self.path}/log", "batch") if n > after and (upto is None or n <= upto)]
        return self.spark.read.parquet(*(f"{self.path}/log/batch={n}" for n in since)) if since else None

    def fold(self, upto: int) -> None:
        """Bring the log up to a batch into the snapshot; buckets without news keep their files."""
        version = self.version()
        manifest = self._manifest(version)
        log = self._log(version, upto)
        if upto > version and log is not None:
            bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
            news = log.withColumn("bucket", bucket)
            touched = [r["bucket"] for r in news.select("bucket").distinct().collect()]  # at most `buckets` rows
            old = self._snapshot(manifest, touched)
            rows = self.merge(log if old is None else old.unionByName(log)).withColumn("bucket", bucket)
            rows.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/snapshot/version={upto}")
            now = manifest | dict.fromkeys(touched, upto)
            self.spark.createDataFrame([(b, v) for b, v in now.items()], "bucket int, written int").coalesce(1).write.mode("overwrite").parquet(
                f"{self.path}/manifest/version={upto}")
            self._clean(version)

    def _clean(self, before: int) -> None:
        """Drop what neither the newest snapshot nor the one before it needs; a reader may still be on the latter."""
        versions = numbered(self.spark, f"{self.path}/manifest", "version")
        used = {v for n in versions if n >= before for v in self._manifest(n).values()}
        for v in versions:
            if v < before:
                remove(self.spark, f"{self.path}/manifest/version={v}")
        for v in numbered(self.spark, f"{self.path}/snapshot", "version"):
            if v not in used:
                remove(self.spark, f"{self.path}/snapshot/version={v}")
        for n in numbered(self.spark, f"{self.path}/log", "batch"):
            if n <= before:
                remove(self.spark, f"{self.path}/log/batch={n}")

    def read(self) -> DataFrame:
        """The current row of every key: the snapshot and the batches since."""
        version = self.version()
        manifest = self._manifest(version)
        parts = [p for p in (self._snapshot(manifest, sorted(manifest)), self._log(version)) if p is not None]
        if not parts:
            raise ValueError(f"nothing is stored in {self.path}")
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self.merge(whole)
