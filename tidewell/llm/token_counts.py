"""Rollups of token counts that signed changes keep up to date.

Counts are additive: an insert adds a document's counts to the totals of its source,
language and tokenizer version, a delete takes them away, a revision is a delete of the
old counts and an insert of the new ones. A batch of changes is summed to one row per
group (partial sums first, so that a source with a third of the rows is one row per
task) and committed as a folder of its own, by one rename: a batch either is there or
is not. Committing a batch again does nothing, so a writer that lost track may simply
retry. Totals are the sums over the last snapshot and the batches committed since;
``compact`` folds these batches into a new snapshot, so totals do not grow with history.

The store must rename folders atomically, as HDFS and local file systems do. Object
stores that copy on rename need a committer in front (or a store with such a rename).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.tokenizers import byte_bpe, encode_added
from tidewell.session import prepare

GROUP = ("source", "lang", "tokenizer")
MEASURES = ("n_docs", "n_tokens", "n_chars")
SCHEMA = "batch_id string, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


COUNTED = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def _count(batches: Iterator[pa.RecordBatch], versions: dict[str, str]) -> Iterator[pa.RecordBatch]:
    encodings = {v: byte_bpe(path) for v, path in versions.items()}
    for batch in batches:
        texts, rows = batch.column("text").to_pylist(), batch.num_rows
        chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).cast(pa.int64())
        for version, encoding in encodings.items():
            n = pa.array([len(encode_added(encoding, t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array([version] * rows, pa.string()), pa.array([1] * rows, pa.int64()), n, chars], names=["doc_id", *GROUP, *MEASURES])


def counts_by(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """A row per document and tokenizer version (version -> file of ranks), in one pass
    over the texts: doc_id, source, lang, tokenizer, n_docs (1), n_tokens, n_chars (code
    points) of the whole text.

    A null or empty text counts as a document of no tokens. Repeated rows count
    repeatedly, null ids, sources and languages are kept. Other columns are not read. An
    empty table gives no rows.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "source", "lang", "text").mapInArrow(partial(_count, versions=versions), COUNTED)


def counts(docs: DataFrame, ranks_path: str, version: str) -> DataFrame:
    """``counts_by`` for one version."""
    return counts_by(docs, {version: ranks_path})


def inserted(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, *MEASURES)


def deleted(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, *((-F.col(m)).alias(m) for m in MEASURES))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents whose counts, source or language changed."""
    return deleted(old).unionByName(inserted(new))


class Rollup:
    """The committed batches and snapshots below one folder of a store that Spark reads.

    Nulls in group columns are groups of their own. Repeated rows of a batch add up. Empty
    batches are committed like others and change nothing; without batches totals are empty.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, prefix: str) -> list[str]:
        if not self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)):
            return []
        return sorted(x.getPath().getName()[len(prefix) :] for x in self.fs.globStatus(self._path(f"{prefix}*")))

    def _snapshot(self) -> str | None:
        """The last snapshot's folder."""
        found = self._names("snapshot-")
        return f"{self.folder}/snapshot-{found[-1]}" if found else None

    def _publish(self, staged: str, name: str) -> bool:
        """Rename a staged folder; False, with the folder deleted, if the name is taken."""
        target = self._path(name)
        if not self.fs.exists(target) and self.fs.rename(self._path(staged), target):
            # a rename onto a folder that came up meanwhile lands inside it
            inner = self._path(f"{name}/{staged}")
            if not self.fs.exists(inner):
                return True
            self.fs.delete(inner, True)
        self.fs.delete(self._path(staged), True)
        return False

    def has(self, batch_id: str) -> bool:
        """Whether a batch is committed, in a folder of its own or in a snapshot."""
        if self.fs.exists(self._path(f"batch-{batch_id}")):
            return True
        last = self._snapshot()
        return last is not None and bool(self.spark.read.parquet(f"{last}/batches").where(F.col("batch_id") == batch_id).head(1))

    def commit(self, batch_id: str, *changes: DataFrame) -> bool:
        """Add a batch of changes; False, with nothing read or changed, if it is there.

        Writers that commit one batch at the same time race for a rename; the losers'
        work is deleted.
        """
        if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id):
            raise ValueError("a batch id has letters, digits, '-', '_' and '.'")
        if self.has(batch_id):
            return False
        rows = reduce(DataFrame.unionByName, [c.select(*GROUP, *MEASURES) for c in changes])
        staged = f"staged-{batch_id}-{uuid.uuid4().hex}"
        _summed(rows).select(F.lit(batch_id).alias("batch_id"), *GROUP, *MEASURES).repartition(1).write.parquet(f"{self.folder}/{staged}")
        return self._publish(staged, f"batch-{batch_id}")

    def batches(self) -> list[str]:
        """Ids of all committed batches."""
        last = self._snapshot()
        old = [r[0] for r in self.spark.read.parquet(f"{last}/batches").collect()] if last else []
        return sorted({*old, *self._names("batch-")})

    def deltas(self) -> DataFrame:
        """Rows of the last snapshot (batch_id null) and of the batches since."""
        last, read = self._snapshot(), self.spark.read.schema(SCHEMA)
        names = self._names("batch-")
        rows = read.parquet(*(f"{self.folder}/batch-{n}" for n in names)) if names else self.spark.createDataFrame([], SCHEMA)
        if last:  # folders of batches that the snapshot holds may still be there
            rows = rows.join(self.spark.read.parquet(f"{last}/batches"), "batch_id", "left_anti").unionByName(read.parquet(f"{last}/totals"))
        return rows

    def totals(self) -> DataFrame:
        """Sums by group; groups that came down to nothing are left out."""
        return _summed(self.deltas()).where(" or ".join(f"{m} <> 0" for m in MEASURES))

    def compact(self) -> bool:
        """Fold all batches into a new snapshot, commit it by one rename, then delete what
        it replaces; False if another writer was first. A crash on the way leaves either
        the old state or the new one, with folders that the next compaction deletes.
        Readers that began before must read again."""
        folders, last = self._names("batch-"), self._names("snapshot-")
        number = int(last[-1]) + 1 if last else 0
        staged = f"staged-snapshot-{uuid.uuid4().hex}"
        self.totals().select(F.lit(None).cast("string").alias("batch_id"), *GROUP, *MEASURES).repartition(1).write.parquet(f"{self.folder}/{staged}/totals")
        self.spark.createDataFrame([(x,) for x in self.batches()], "batch_id string").repartition(1).write.parquet(f"{self.folder}/{staged}/batches")
        if not self._publish(staged, f"snapshot-{number:012d}"):
            return False
        for name in [*(f"batch-{x}" for x in folders), *(f"snapshot-{x}" for x in last)]:
            self.fs.delete(self._path(name), True)
        return True


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES))
