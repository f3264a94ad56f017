"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A change is a row (source, lang, tokenizer, n_docs, n_tokens): an insert counts
+1 document and its tokens, a delete -1 and minus its tokens, a revised count the
new row minus the old one. ``Rollup.commit`` sums a batch of changes (Spark
aggregates before it shuffles, so a hot source costs nothing) and writes the few
sums into a folder of the batch's own; the writer's success mark is the commit. A
batch that was committed before is left as it is, one that broke off is written
anew, so replays change nothing. ``totals`` adds up the live batches.

``compact`` folds the live batches into one. A fold says itself which batches it
holds: their names are written first, its sums after them, and the success mark of
the sums is the commit of both. From then on the batches it names aren't live,
whether their folders are still there or not, so a driver lost at any step leaves
the totals as they were, and replays of folded batches still change nothing.

Defined results: a null text has 0 tokens and counts as a document; null sources
and languages are groups of their own; repeated rows count each time. Groups whose
documents and tokens are both down to 0 are left out. Extra columns are ignored;
an empty table gives no totals, and an empty batch can be committed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the rank file's merges were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS, BPE = "words-1", "byte-bpe-50k-1"


def _ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def count_tokens(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, source, lang, words, estimate (a quarter of the characters) and tokens (byte-level BPE) of each row.

    The vocabulary is read on the driver and broadcast; its size is the file's.
    """
    shared = documents.sparkSession.sparkContext.broadcast(_ranks(ranks))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            n = np.array([len(bpe.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n)], [*batch.schema.names[1:], "tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        text.alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        "lang",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.ceil(F.length(text) / 4).cast("long").alias("estimate"),
    )
    return rows.mapInArrow(counted, "doc_id long, source string, lang string, words long, estimate long, tokens long")


def change(counts: DataFrame, tokenizer: str, count: str, sign: int = 1) -> DataFrame:
    """The change that adds (sign 1) or takes away (-1) each row of ``counts`` with its ``count``."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), (sign * F.col(count)).cast("long").alias("n_tokens"))


def revision(old: DataFrame, new: DataFrame, tokenizer: str, old_count: str, new_count: str) -> DataFrame:
    """The change from the rows of ``old`` to those of ``new``: counts, sources or languages may differ."""
    return change(new, tokenizer, new_count).unionByName(change(old, tokenizer, old_count, -1))


class Rollup:
    """Totals in a folder that all executors share; one writer at a time, readers at any time but during ``clean``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _dir(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _committed(self, kind: str, inner: str = "") -> list[str]:
        fs, top = self._dir(f"{self.path}/{kind}")
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(n for n in names if fs.exists(self._dir(f"{self.path}/{kind}/{n}{inner}/_SUCCESS")[1]))

    def _state(self) -> tuple[set[str], list[str], list[str]]:
        """(batches that a fold holds, live folds, live batches)."""
        folds = self._committed("folds", "/sums")
        held = {r[0] for r in self.spark.read.schema("name string").parquet(*[f"{self.path}/folds/{f}/names" for f in folds]).collect()} if folds else set()
        return held, folds[-1:], [b for b in self._committed("batches") if b not in held]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commits ``changes`` under the name ``batch``; False, and nothing is done, if it was committed before."""
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        held, _, live = self._state()
        if batch in held or batch in live:
            return False
        self._write(f"batches/{batch}", self.summed(changes))
        return True

    def _write(self, to: str, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{to}")

    @staticmethod
    def summed(changes: DataFrame) -> DataFrame:
        sums = changes.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens over all committed batches."""
        _, folds, live = self._state()
        paths = [f"{self.path}/folds/{f}/sums" for f in folds] + [f"{self.path}/batches/{b}" for b in live]
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        return self.summed(self.spark.read.schema(DELTA).parquet(*paths))

    def compact(self) -> None:
        """Folds all live batches and the fold before into a new fold, then deletes what it holds."""
        held, folds, live = self._state()
        if live:
            name = f"{int(folds[-1]) + 1 if folds else 1:012d}"
            self._write(f"folds/{name}/names", self.spark.createDataFrame([(b,) for b in sorted(held | set(live))], "name string"))
            self._write(f"folds/{name}/sums", self.totals())
        self.clean()

    def clean(self) -> None:
        """Deletes the folders of folded batches and of all folds but the last; nothing that ``totals`` reads."""
        held, folds, _ = self._state()
        for fold in self._committed("folds", "/sums"):
            if fold not in folds:
                self._delete(f"folds/{fold}")
        for batch in self._committed("batches"):
            if batch in held:
                self._delete(f"batches/{batch}")

    def _delete(self, what: str) -> None:
        fs, path = self._dir(f"{self.path}/{what}")
        fs.delete(path, True)


def union(*changes: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, changes)
