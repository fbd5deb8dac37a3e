"""Token counts as delta-maintained rollups.

Changes of documents are signed rows: an insert adds a document and its tokens, a delete takes them
away, a revision takes the old count away and adds the new one. A batch of changes is summed by source,
language and tokenizer version before it is stored, so the rollup's deltas stay small whatever the batch
holds, and sums before the shuffle keep a source with a third of all rows in no single task.

A ledger keeps each document's counts, without its text, so deletes and revisions read numbers and the
texts of the batch itself, never the corpus. Its batches are signed rows as well and count only if the
rollup's folder of their name does; a compaction sums them too, so a ledger holds no more rows than documents.

Commits are idempotent: a batch is stored under its own name by Spark's committer, whose marker makes it
part of the rollup; a batch that has its marker is skipped, and what a failed try left is replaced. A
compaction holds the names that it stands for in its own table, so one marker switches from them to it:
their folders don't count from then on, deleted or not, and none of the names can be committed again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of other characters than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    """Tokens of a byte-level model: the UTF-8 bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bpe(path: str, pattern: str) -> Callable[[Column], Column]:
    """Counter of a byte-pair vocabulary in tiktoken's format at ``path`` (readable on every executor)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import base64

        import tiktoken

        if not hasattr(bpe, "held") or bpe.held[0] != path:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            bpe.held = path, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda t: len(bpe.held[1].encode_ordinary(t)) if t else 0).astype("int64")

    return count


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"words-1": words, "bytes-1": utf8_bytes}


def signed(docs: DataFrame, sign: int, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS) -> DataFrame:
    """Change rows (KEYS, docs, tokens) of documents (text, lang, source); sign 1 inserts, -1 deletes."""
    each = F.array(*(F.struct(F.lit(k).alias("tokenizer"), f(F.col("text")).alias("n")) for k, f in tokenizers.items()))
    rows = docs.select("source", "lang", F.explode_outer(each).alias("c"))  # never empty; explode adds a filter that counts all texts again
    return rows.select("source", "lang", "c.tokenizer", F.lit(sign).cast("long").alias("docs"), (F.col("c.n") * sign).alias("tokens"))


def revised(changes: DataFrame) -> DataFrame:
    """Change rows of revisions (KEYS, old_tokens, new_tokens): the number of documents stays."""
    return changes.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col("new_tokens") - F.col("old_tokens")).alias("tokens"))


LEDGER = "doc_id long, text_hash long, source string, lang string, counts array<struct<tokenizer:string,n:long>>, copies long"
STORED = f"{SCHEMA}, covers string"


class TokenRollup:
    """A rollup in a folder of a shared store: a small table of deltas and one of ledger rows for each committed batch.

    There is one writer at a time; readers need no lock.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS):
        self.spark, self.folder, self.tokenizers = spark, folder, tokenizers
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(sc._jsc.hadoopConfiguration())

    def _marked(self) -> list[str]:
        """Folders of deltas that their committer finished."""
        root = self._path(f"{self.folder}/deltas")
        names = (s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else ()
        return sorted(n for n in names if self._fs.exists(self._path(f"{self.folder}/deltas/{n}/_SUCCESS")))

    def _read(self, names: list[str]) -> DataFrame:
        paths = [f"{self.folder}/deltas/{n}" for n in names]
        return self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def _names(self, marked: list[str]) -> DataFrame:
        """Names (covers) that compactions stand for: one for each batch ever compacted, so they stay in tables."""
        return self._read([n for n in marked if n.startswith("compact-")]).where("covers IS NOT NULL").select("covers").distinct()

    def _covered(self, marked: list[str]) -> set[str]:
        """Those of the marked folders that a compaction stands for."""
        if not any(n.startswith("compact-") for n in marked):
            return set()
        return {r[0] for r in self._names(marked).where(F.col("covers").isin(marked)).collect()}

    def live(self) -> list[str]:
        """Folders whose deltas and ledger rows count now: a compaction and the batches since."""
        marked = self._marked()
        covered = self._covered(marked)
        return [n for n in marked if n not in covered]

    def has(self, batch: str) -> bool:
        """Whether the rollup has a batch, by its own folder or by a compaction."""
        marked = self._marked()
        return batch in marked or not self._names(marked).where(F.col("covers") == batch).isEmpty()

    def committed(self) -> DataFrame:
        """Names (batch) of all batches in the rollup, those that compactions stand for among them."""
        marked = self._marked()
        own = self.spark.createDataFrame([(n,) for n in marked], "batch string")
        return own.union(self._names(marked)).distinct().where("NOT startswith(batch, 'compact-')")

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Add a batch of change rows (KEYS, docs, tokens); False if it is in the rollup already."""
        if batch.startswith("compact-"):
            raise ValueError("names of compactions are the rollup's own")
        if self.has(batch):
            return False
        self._fs.delete(self._path(f"{self.folder}/ledger/{batch}"), True)  # of a failed try
        rows = changes[0]
        for c in changes[1:]:
            rows = rows.unionByName(c)
        self._store(batch, rows)
        return True

    def _store(self, name: str, rows: DataFrame, covers: DataFrame | None = None) -> None:
        summed = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        out = summed.withColumn("covers", F.lit(None).cast("string"))
        if covers is not None:
            none = [F.lit(None).cast("string").alias(k) for k in KEYS]
            zero = [F.lit(0).cast("long").alias(k) for k in ("docs", "tokens")]
            out = out.unionByName(covers.select(*none, *zero, "covers"))
        out.write.mode("overwrite").parquet(f"{self.folder}/deltas/{name}")

    def _record(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch of signed ledger rows, first to the ledger, then as deltas: only these make it count."""
        if self.has(batch):
            return False
        path = f"{self.folder}/ledger/{batch}"
        rows.select("doc_id", "text_hash", "source", "lang", "counts", "copies").write.mode("overwrite").parquet(path)
        kept = self.spark.read.schema(LEDGER).parquet(path)
        each = kept.select("source", "lang", "copies", F.explode_outer("counts").alias("c"))
        self._store(batch, each.select("source", "lang", "c.tokenizer", F.col("copies").alias("docs"), (F.col("c.n") * F.col("copies")).alias("tokens")))
        return True

    def _counted(self, docs: DataFrame, *keep: str) -> DataFrame:
        each = (F.struct(F.lit(k).alias("tokenizer"), f(F.col("text")).alias("n")) for k, f in self.tokenizers.items())
        return docs.select(*keep, F.xxhash64("text").alias("text_hash"), F.array(*each).alias("counts"))

    def ledger(self, ids: DataFrame | None = None) -> DataFrame:
        """LEDGER rows of the documents that the rollup counts now; of ids (doc_id, null-safe) only where given."""
        paths = [f"{self.folder}/ledger/{n}" for n in self.live() if self._fs.exists(self._path(f"{self.folder}/ledger/{n}"))]
        rows = self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)
        if ids is not None:
            own = ids.select(F.col("doc_id").alias("own")).distinct()
            rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
        now = rows.groupBy("doc_id", "text_hash", "source", "lang").agg(F.first("counts").alias("counts"), F.sum("copies").alias("copies"))
        return now.where("copies > 0")

    def insert(self, batch: str, docs: DataFrame) -> bool:
        """Add documents (doc_id, text, lang, source); False if the batch is in the rollup already."""
        return self._record(batch, self._counted(docs, "doc_id", "source", "lang").withColumn("copies", F.lit(1).cast("long")))

    def delete(self, batch: str, ids: DataFrame) -> bool:
        """Take away all documents with a doc_id of ids; null and unknown ones have no effect."""
        gone = self.ledger(ids.where("doc_id IS NOT NULL"))
        return self._record(batch, gone.withColumn("copies", -F.col("copies")))

    def revise(self, batch: str, revised: DataFrame) -> bool:
        """Replace documents by revised (doc_id, replaces, text): ``replaces`` is the xxhash64 of the text that goes.

        Source and language stay. Versions that the rollup doesn't count have no effect; of several revisions of one the
        one with the smallest text_hash is taken.
        """
        new = self._counted(revised, F.col("doc_id").alias("id"), "replaces").withColumnRenamed("counts", "new")
        new = new.groupBy("id", "replaces").agg(F.min(F.struct("text_hash", "new")).alias("n"))
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("replaces"))
        both = self.ledger(revised.select("doc_id")).join(new, same)
        signed_rows = F.explode(F.array(
            F.struct("text_hash", "counts", (-F.col("copies")).alias("copies")), F.struct(F.col("n.text_hash").alias("text_hash"), F.col("n.new").alias("counts"), "copies")
        ))
        return self._record(batch, both.select("doc_id", "source", "lang", signed_rows.alias("r")).select("doc_id", "source", "lang", "r.*"))

    def totals(self) -> DataFrame:
        """(KEYS, docs, tokens) over all committed batches; groups whose sums are all zero are gone."""
        rows = self._read(self.live()).where("covers IS NULL")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> str:
        """Sum the live deltas into one table and the ledger into another, which then stand for them; what they stand for is deleted.

        The table of deltas is written last: a crash before its marker leaves all as it was, one after it only leaves folders
        that no longer count; the next compaction deletes them.
        """
        marked = self._marked()
        live = self.live()
        name = f"compact-{uuid.uuid4().hex}"
        self.ledger().select("doc_id", "text_hash", "source", "lang", "counts", "copies").write.parquet(f"{self.folder}/ledger/{name}")
        covers = self.spark.createDataFrame([(n,) for n in marked], "covers string").union(self._names(marked)).distinct()
        self._store(name, self._read(live).where("covers IS NULL").select(*KEYS, "docs", "tokens"), covers)
        self._clean()
        return name

    def _clean(self) -> None:
        """Delete the folders that compactions stand for, a batch's ledger rows first, and the ledgers of compactions that failed."""
        marked = self._marked()
        covered = self._covered(marked)
        root = self._path(f"{self.folder}/ledger")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        for n in names:
            if n in covered or n.startswith("compact-") and n not in marked:
                self._fs.delete(self._path(f"{self.folder}/ledger/{n}"), True)
        for n in covered:
            self._fs.delete(self._path(f"{self.folder}/deltas/{n}"), True)


#: What the registered query's revision takes out of texts.
REVISED = "[0-9]+"


def maintained_counts(docs: DataFrame, removed: DataFrame, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS, pattern: str = REVISED) -> DataFrame:
    """Totals (source, lang, tokenizer, docs, tokens) of docs (doc_id, text, lang, source) after a load, deletes and revisions.

    All documents are inserted, those in removed (doc_id) deleted, texts that match ``pattern`` revised by taking the
    matches out; then the batches are compacted and the load repeated as a retried job would, without effect. Null
    sources and languages are groups of their own; null texts have 0 tokens; repeated rows count each; repeated
    or unknown ids in removed have no further effect.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    rollup = TokenRollup(docs.sparkSession, scratch.path("rollup"), tokenizers)
    docs = docs.select("doc_id", "text", "lang", "source")
    rollup.insert("load", docs)
    rollup.delete("removals", removed)
    changed = docs.where(F.col("text").rlike(pattern))
    rollup.revise("revisions", changed.select("doc_id", F.xxhash64("text").alias("replaces"), F.regexp_replace("text", pattern, "").alias("text")))
    rollup.compact()
    rollup.insert("load", docs)
    return rollup.totals()
