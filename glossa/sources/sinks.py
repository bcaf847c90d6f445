"""Writers (S5, S11-S14, S23-S26, P7 of splits): all are Spark's own, so that commits survive lost tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.sources.readers import EMPTY
from glossa.sources.storage import commit, commits, remove


def write_tsv(df: DataFrame, path: str, gzip: bool = False, empty: str = EMPTY) -> None:
    """Headerless tab-separated text; nulls as the mark for empty values, tabs and line ends as spaces."""
    cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(empty)), r"[\t\r\n]", " ") for c in df.columns]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def write_header_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text whose files begin with the columns' names (S2); quotes are ordinary characters."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(path)


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header; quotes inside values are doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_vocabulary(df: DataFrame, path: str) -> None:
    """id, word, tf, JSON vector."""
    write_tsv(df.select("id", "word", "tf", F.to_json("semantic").alias("semantic")), path, empty="{}")


def write_split(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder a key."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_batches(df: DataFrame, path: str, rows: int) -> None:
    """Gzip text files of at most ``rows`` lines."""
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "gzip").text(path)


def write_latex(df: DataFrame, path: str) -> None:
    """Rows of a table body."""
    df.select(F.concat(F.concat_ws(" & ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" \\\\")).alias("value")).write.mode("overwrite").text(path)


def write_libsvm(df: DataFrame, path: str, label: str, features: str) -> None:
    """Label and vector rows for trainers."""
    df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features")).write.mode("overwrite").format("libsvm").save(path)


def write_mapping(df: DataFrame, path: str, entity: str, category: str) -> None:
    """entity -> its categories."""
    ok = df.filter((F.col(entity) != "") & (F.col(category) != "") & ~F.col(entity).rlike(r"\s") & ~F.col(category).rlike(r"\s"))
    ok.select(entity, category).distinct().groupBy(entity).agg(F.sort_array(F.collect_list(category)).alias("categories")).write.mode("overwrite").parquet(path)


class KeyedTable:
    """A keyed Parquet table with upserts.

    Every version is a folder of its own and a small file ``vN.commit`` that
    names it. The file is created only if it is not there: a reader sees a whole
    version, a failed write none, and of two writers that meet the later one
    merges its rows into the other's version.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _versions(self) -> dict[int, str]:
        return {int(p.rpartition("/v")[2][: -len(".commit")]): folder for p, folder in commits(self.spark, f"{self.root}/v*.commit").items()}

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        return max(self._versions(), default=0)

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.root}/{versions[max(versions)]}") if versions else None

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """Rows whose key the others lack; a null is a key like any other."""
        keys = others.select(F.col(self.key).alias("_other"))
        return rows.join(keys, rows[self.key].eqNullSafe(keys["_other"]), "left_anti")

    def upsert(self, rows: DataFrame, overwrite: bool = True) -> None:
        """Put rows by key: new keys are added; those there are replaced, or with overwrite=False kept.

        Of rows that repeat a key the greatest by its other columns counts. A
        null key is a key of its own.
        """
        others = [c for c in rows.columns if c != self.key]
        rows = rows.groupBy(self.key).agg(F.max(F.struct(*others)).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) if c != self.key else F.col(c) for c in rows.columns])
        while True:
            v = self.version() + 1
            old = self.read()
            if old is None:
                merged = rows
            elif overwrite:
                merged = self._without(old, rows).unionByName(rows)
            else:
                merged = old.unionByName(self._without(rows, old))
            folder = f"data-{uuid.uuid4().hex}"
            merged.write.parquet(f"{self.root}/{folder}")
            if commit(self.spark, f"{self.root}/v{v}.commit", folder):
                return
            remove(self.spark, f"{self.root}/{folder}")


def corpus_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows in the order of a hash of a key: the small corpora for development (O2)."""
    return df.orderBy(F.xxhash64(key)).limit(most)
