"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of deltas (inserts, deletes, revised counts) is summed per group and written as one folder named by the batch: under
another name first, then renamed, so that a folder of that name is whole. A batch that was committed is not applied
again, whoever repeats it. Totals are a snapshot plus the batches since; `compact` makes a new snapshot of both, which
lists the batches that it holds, so that reading stays cheap however many there were.
"""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import bytes_of, chunks
from ._words import WordTokenizer

GROUP = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    """Totals in the folder `path`, which all executors must see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        return f"{self.path}/batch-{batch}"

    def _names(self, prefix: str) -> list[str]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = (x.getPath().getName() for x in fs.listStatus(p))
        return sorted(x.removeprefix(prefix) for x in names if x.startswith(prefix))

    def _snapshot(self) -> str | None:
        """Folder of the newest snapshot."""
        names = self._names("snapshot-")
        return f"{self.path}/snapshot-{max(names, key=int)}" if names else None

    def _held(self) -> set[str]:
        """Batches that the snapshot holds."""
        last = self._snapshot()
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{last}/batches").collect()} if last else set()

    def _whole(self, batch: str) -> bool:
        fs, p = self._fs(f"{self._folder(batch)}/_SUCCESS")
        return bool(fs.exists(p))

    def _batches(self) -> list[str]:
        return [b for b in self._names("batch-") if self._whole(b)]

    def committed(self) -> list[str]:
        return sorted(set(self._batches()) | self._held())

    def is_committed(self, batch: str) -> bool:
        return self._whole(batch) or batch in self._held()

    def _moved(self, source: str, target: str) -> bool:
        """Renames a folder; False, and the folder is gone, if another writer was first."""
        (fs, a), (_, b) = self._fs(source), self._fs(target)
        done = not fs.exists(b) and fs.rename(a, b)
        inside = self._fs(f"{target}/{source.rsplit('/', 1)[1]}")[1]  # some file systems move into a folder that is there
        if done and fs.exists(inside):
            done = False
            fs.delete(inside, True)
        if not done:
            fs.delete(a, True)
        return bool(done)

    def _draft(self) -> str:
        return f"{self.path}/draft-{uuid.uuid4().hex}"

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of deltas: kind ('insert', 'delete', 'revise'), source, lang, tokenizer, n_tokens and, for a revised
        count, old_tokens. False, and nothing done, if the batch is there already.

        A null count is 0; null groups are groups of their own; every row counts, so that repeated ones add up. Rows of
        another kind are an error. An empty batch is committed as such."""
        if self.is_committed(batch):
            return False
        n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        kind = F.col("kind")
        docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown kind of delta: "), F.coalesce(kind, F.lit("null")))))
        tokens = F.when(kind == "insert", n).when(kind == "delete", -n).otherwise(n - old)
        summed = deltas.select(*(F.col(c).cast("string").alias(c) for c in GROUP), docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens")).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        draft = self._draft()
        summed.write.parquet(draft)
        fs, broken = self._fs(self._folder(batch))
        if fs.exists(broken) and not self._whole(batch):
            fs.delete(broken, True)
        return self._moved(draft, self._folder(batch))

    def _summed(self, held: set[str]) -> DataFrame | None:
        last = self._snapshot()
        folders = [self._folder(b) for b in self._batches() if b not in held] + ([f"{last}/totals"] if last else [])
        if not folders:
            return None
        every = self.spark.read.schema(_SCHEMA).parquet(*folders)
        return every.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Makes a snapshot of all totals and removes what it replaces. A reader that began before may have to begin again."""
        held, new = self._held(), self._batches()
        summed = self._summed(held)
        if summed is None:
            return
        last = self._snapshot()
        draft = self._draft()
        summed.write.parquet(f"{draft}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(held | set(new))], "batch string").coalesce(1).write.parquet(f"{draft}/batches")
        number = int(last.rsplit("-", 1)[1]) + 1 if last else 0
        if self._moved(draft, f"{self.path}/snapshot-{number}"):
            for old in [self._folder(b) for b in new] + ([last] if last else []):
                fs, p = self._fs(old)
                fs.delete(p, True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups whose documents are all gone are left out."""
        summed = self._summed(self._held())
        if summed is None:
            return self.spark.createDataFrame([], _SCHEMA)
        return summed.where("n_docs <> 0 or n_tokens <> 0")


class _Ranks:
    """Counts by a file of ranks, for the library that splits texts by a pattern and merges bytes by rank."""

    loaded: dict[tuple[str, int], _Ranks] = {}  # noqa: RUF012

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def at(cls, path: str) -> _Ranks:
        key = (path, os.getpid())
        if key not in cls.loaded:
            cls.loaded[key] = cls(path)
        return cls.loaded[key]

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        return np.array([len(self.encoding.encode_ordinary(raw[a:z].decode("utf-8", "replace"))) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)


def tokenizer_counts(docs: DataFrame, tokenizers: dict[str, str], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns to carry as strings, tokenizer, n_tokens) of every text by each tokenizer file: tokenizers maps a
    version to its path, a file of ranks if it ends in .tiktoken. A null text has no tokens."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in carry), F.col(text_col).cast("string").alias("_text"))
    names = ["doc_id", *carry, "tokenizer", "n_tokens"]

    def run(batches):
        for b in batches:
            data, off = bytes_of(b["_text"])
            for i, j in chunks(off, 2 << 20):
                own = b.slice(i, j - i)
                for version, path in tokenizers.items():
                    given = data[off[i] : off[j]], off[i : j + 1] - off[i]
                    n = _Ranks.at(path).counts(*given) if path.endswith(".tiktoken") else WordTokenizer.at(path).encode(*given, None)[1]
                    yield pa.RecordBatch.from_arrays([*(own[c] for c in names[:-2]), pa.array([version] * (j - i)), pa.array(n, pa.int64())], names=names)

    return d.mapInArrow(run, "doc_id long, " + "".join(f"`{c}` string, " for c in carry) + "tokenizer string, n_tokens long")


def insert_deltas(counts: DataFrame) -> DataFrame:
    """Inserts from (source, lang, tokenizer, n_tokens)."""
    return counts.select(F.lit("insert").alias("kind"), *GROUP, "n_tokens", F.lit(None).cast("long").alias("old_tokens"))


def delete_deltas(counts: DataFrame) -> DataFrame:
    """Deletes of documents with their present counts."""
    return counts.select(F.lit("delete").alias("kind"), *GROUP, "n_tokens", F.lit(None).cast("long").alias("old_tokens"))


def revise_deltas(counts: DataFrame) -> DataFrame:
    """Revised counts from (source, lang, tokenizer, n_tokens, old_tokens)."""
    return counts.select(F.lit("revise").alias("kind"), *GROUP, "n_tokens", "old_tokens")
