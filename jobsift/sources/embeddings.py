"""A store of text embeddings that is saved once and loaded later.

Vectors are keyed by the MD5 of their text.  Each update encodes only the texts
that the store lacks, writes them as files of their own and then makes them part
of the table by one small marker file, created exclusively: readers see the old
version or the new one, a failed update leaves the old, and of two writers of the
same version one fails.  An older version can be read as long as it is not
compacted away.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.operators.vectors import embed_texts

SCHEMA = "text_hash string, vec array<double>"


def text_hash(text: str):
    return F.md5(F.col(text)).alias("text_hash")


class EmbeddingStore:
    """``path/rows/<folder>`` holds vectors, ``path/versions/<number>`` says
    which folders make up a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder))

    def _folders(self, version: int) -> list[str]:
        text = self.spark.read.text(f"{self.path}/versions/{version:08d}")
        return [r.value for r in text.collect()]

    def load(self, version: int | None = None) -> DataFrame:
        """(text_hash, vec) of a version, the latest by default; no rows before
        the first."""
        known = self.versions()
        if version is None and not known:
            return self.spark.createDataFrame([], SCHEMA)
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"the store has no version {version}")
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/rows/{f}" for f in self._folders(version)])

    def missing(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """(text_hash, text): distinct non-null texts that the store lacks."""
        keyed = texts.select(text_hash(text), F.col(text).alias("text")).filter("text IS NOT NULL").dropDuplicates(["text_hash"])
        return keyed.join(self.load().select("text_hash"), "text_hash", "left_anti")

    def update(self, texts: DataFrame, text: str = "text", encoder: Callable | None = None, **options) -> int:
        """Encode and add what is missing; the number of texts encoded.  Nothing
        missing leaves the version as it is."""
        new = embed_texts(self.missing(texts, text), "text", encoder, **options).select(text_hash("text"), "vec")
        folder = uuid.uuid4().hex
        new.write.parquet(f"{self.path}/rows/{folder}")
        added = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/rows/{folder}").count()
        if added:
            known = self.versions()
            self._mark([*(self._folders(known[-1]) if known else []), folder])
        else:
            self._fs.delete(self._hadoop(f"{self.path}/rows/{folder}"), True)
        return added

    def compact(self) -> None:
        """One folder for all vectors, as a new version; older versions go."""
        old = self.versions()
        folder = uuid.uuid4().hex
        self.load().write.parquet(f"{self.path}/rows/{folder}")
        gone = {f for v in old for f in self._folders(v)}
        self._mark([folder])
        for v in old:
            self._fs.delete(self._hadoop(f"{self.path}/versions/{v:08d}"), False)
        for f in gone:
            self._fs.delete(self._hadoop(f"{self.path}/rows/{f}"), True)

    def _mark(self, folders: list[str]) -> None:
        known = self.versions()
        marker = self._hadoop(f"{self.path}/versions/{(known[-1] if known else 0) + 1:08d}")
        out = self._fs.create(marker, False)
        out.write(bytearray("\n".join(folders).encode()))
        out.close()

    def vectors(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """Rows of ``texts`` with ``vec`` (null where the store lacks the text)."""
        return texts.withColumn("text_hash", F.md5(F.col(text))).join(self.load(), "text_hash", "left").drop("text_hash")
