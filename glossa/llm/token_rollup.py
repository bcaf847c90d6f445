"""Token counts kept up by deltas.

Changes to documents arrive in batches: inserts, deletes and revised counts.
Each batch is summed to signed deltas of documents and tokens by source,
language and tokenizer version and committed once under its name; totals are
the sums of the committed deltas, of which ``compact`` makes one table. A batch that is delivered again changes
nothing, and one whose write was cut short is written anew.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.shared import slices
from glossa.sources.storage import commit, commits, remove, written

KEYS = ["source", "lang", "tokenizer"]
_DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """Additive totals in a folder that all executors share.

    A batch is written to a folder of its own and committed by a small file
    under the batch's name, which can be created once: of two drivers that apply
    one batch at a time one commits, and a write that was cut short counts for
    nothing. ``compact`` sums up the batches so far in one table that also holds
    their names, so reads and commits look at the batches since then only.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batches(self) -> dict[str, str]:
        """Name and folder of the committed batches that aren't compacted."""
        return {p.rpartition("/")[2][: -len(".commit")]: folder for p, folder in commits(self.spark, f"{self.root}/batches/*.commit").items()}

    def _compacted(self) -> str | None:
        """The folder of the last compaction."""
        found = commits(self.spark, f"{self.root}/compact/*.commit")
        return found[max(found)] if found else None

    def _old_names(self, folder: str | None) -> DataFrame:
        return self.spark.read.schema("name string").parquet(f"{self.root}/compact/{folder}/names") if folder else self.spark.createDataFrame([], "name string")

    def committed(self) -> list[str]:
        """Names of all batches that count."""
        return sorted({r["name"] for r in self._old_names(self._compacted()).collect()} | set(self._batches()))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of (source, lang, tokenizer, op, n_tokens, old_tokens); False if it was committed before.

        op is insert, delete or revise; n_tokens is the count that is added or
        taken away, for revise the new one after old_tokens. Null counts are 0;
        rows of another or no op are left out; null keys are keys of their own.
        Other columns are ignored; an empty batch is committed and adds nothing.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"bad batch name {batch!r}")
        if batch in self._batches() or not self._old_names(self._compacted()).filter(F.col("name") == batch).isEmpty():
            return False
        n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        deltas = changes.select(*KEYS, sign.alias("docs"), F.when(F.col("op") == "revise", n - old).otherwise(sign * n).alias("tokens")).filter("docs is not null")
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("n_docs"), F.sum("tokens").cast("long").alias("n_tokens"))
        folder = f"{batch}-{uuid.uuid4().hex}"
        summed.write.parquet(f"{self.root}/batches/{folder}")
        return commit(self.spark, f"{self.root}/batches/{batch}.commit", folder)

    def _sum(self, compacted: str | None, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/batches/{f}" for f in folders] + ([f"{self.root}/compact/{compacted}/totals"] if compacted else [])
        rows = self.spark.read.schema(_DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over the committed batches."""
        compacted, batches = self._compacted(), self._batches()
        return self._sum_of(compacted, batches)

    def _sum_of(self, compacted: str | None, batches: dict[str, str]) -> DataFrame:
        """Totals of one listing: a compaction and the batches that it doesn't know by name."""
        known = {r["name"] for r in self._old_names(compacted).filter(F.col("name").isin(list(batches))).collect()} if batches else set()
        return self._sum(compacted, [f for b, f in sorted(batches.items()) if b not in known])

    def compact(self) -> None:
        """Sum up what is committed; a batch that was summed up is still known by its name.

        The batches are listed once: one that is committed meanwhile is neither
        summed up nor named, and counts as before. Commit files go after the
        commit of the new table, so a run that dies on the way changes nothing
        that counts. The folders of the batches go with the next compaction:
        totals that were listed before this one can still read them.
        """
        before, batches = self._compacted(), self._batches()
        if not batches:
            return
        name = f"{len(commits(self.spark, f'{self.root}/compact/*.commit')):012d}"
        folder = f"{name}-{uuid.uuid4().hex}"
        self._sum_of(before, batches).write.parquet(f"{self.root}/compact/{folder}/totals")
        names = self._old_names(before).unionByName(self.spark.createDataFrame([(b,) for b in batches], "name string")).distinct()
        names.write.parquet(f"{self.root}/compact/{folder}/names")
        self.spark.createDataFrame([(f,) for f in batches.values()], "folder string").coalesce(1).write.parquet(f"{self.root}/compact/{folder}/folders")
        if commit(self.spark, f"{self.root}/compact/{name}.commit", folder):
            for b in batches:
                remove(self.spark, f"{self.root}/batches/{b}.commit")
            for r in self.spark.read.schema("folder string").parquet(f"{self.root}/compact/{before}/folders").collect() if before else []:
                remove(self.spark, f"{self.root}/batches/{r['folder']}")


_ENCODINGS: dict = {}


def _encoding(path: str, pattern: str):
    import tiktoken

    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def tidy(text: str | None) -> str:
    """Trailing blanks of lines and blank lines go: the revision after which texts are counted anew."""
    return "\n".join(x for x in (line.rstrip() for line in (text or "").split("\n")) if x)


def count_tokens(docs: DataFrame, tokenizers: dict[str, tuple[str, str]]) -> DataFrame:
    """doc_id, source, lang, text_sha256, counts and tidied: maps of tokenizer name to the count of the text and of its tidy form.

    tokenizers: name -> (path of its ranks, pattern). Null texts have 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = {name: _encoding(*at) for name, at in tokenizers.items()}
        kind = pa.map_(pa.string(), pa.int64())
        for b in slices(batches):
            before, after = [], []
            for text in b.column("text").to_pylist():
                clean = tidy(text)
                raw = [(name, len(c.encode_ordinary(text or ""))) for name, c in coders.items()]
                before.append(raw)
                after.append(raw if clean == (text or "") else [(name, len(c.encode_ordinary(clean))) for name, c in coders.items()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "source", "lang", "text_sha256")], pa.array(before, kind), pa.array(after, kind)], ["doc_id", "source", "lang", "text_sha256", "counts", "tidied"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, text_sha256 string, counts map<string,bigint>, tidied map<string,bigint>")


def document_rollup(docs: DataFrame, tokenizers: dict[str, tuple[str, str]], rollup: Rollup, counted: DataFrame | None = None) -> DataFrame:
    """Totals of the documents after four batches, the third of which is delivered twice.

    1. every document is inserted under the first tokenizer version; 2. under
    the others; 3. documents whose text an earlier doc_id has are deleted;
    4. the counts of the rest are revised to their tidy texts'. Returns source,
    lang, tokenizer, n_docs, n_tokens; totals of nothing are left out.
    Documents with a null id never count as copies, repeated rows of one id
    neither; null sources and languages are keys of their own.
    """
    c = counted if counted is not None else count_tokens(docs, tokenizers)
    first, *others = tokenizers
    # written, so that the join's shuffles are its own and a text with very many copies can be split
    least = written(c.groupBy("text_sha256").agg(F.min("doc_id").alias("least")), "least")
    marked = c.join(least, "text_sha256").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))

    def changes(op: str, names: list[str], rows: DataFrame) -> DataFrame:
        each = rows.select("source", "lang", F.explode(F.array(*[F.lit(n) for n in names])).alias("tokenizer"), "counts", "tidied")
        new = F.col("tidied")[F.col("tokenizer")] if op == "revise" else F.col("counts")[F.col("tokenizer")]
        return each.select("source", "lang", "tokenizer", F.lit(op).alias("op"), new.alias("n_tokens"), F.col("counts")[F.col("tokenizer")].alias("old_tokens"))

    rollup.apply("b1-insert", changes("insert", [first], c))
    if others:
        rollup.apply("b2-insert", changes("insert", others, c))
    rollup.apply("b3-copies", changes("delete", [first, *others], marked.filter("copy")))
    rollup.apply("b3-copies", changes("delete", [first, *others], marked.filter("copy")))
    rollup.apply("b4-tidy", changes("revise", [first, *others], marked.filter("not copy")))
    return rollup.totals().filter("n_docs <> 0 or n_tokens <> 0")
