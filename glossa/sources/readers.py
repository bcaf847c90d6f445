"""Readers of the record formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

EMPTY, FAILED, TOO_LARGE = "__EMPTY_VALUE__", "__FAIL__", "__TOO_LARGE__"  # fixed values of the formats
MAX_CONTENT = 500_000


def tsv(spark: SparkSession, path: str, columns: list[str] | StructType, reject: bool = False) -> DataFrame:
    """Headerless tab-separated records by position (S1), gzip or not.

    Quotes are ordinary characters. With ``reject`` a column corrupt holds
    lines with another number of fields, else they have nulls or lose fields.
    """
    schema = columns if isinstance(columns, StructType) else StructType([StructField(c, StringType()) for c in columns])
    reader = spark.read.option("sep", "\t").option("quote", "").option("escape", "").option("mode", "PERMISSIVE")
    if reject:
        schema = StructType([*schema.fields, StructField("corrupt", StringType())])
        reader = reader.option("columnNameOfCorruptRecord", "corrupt").option("enforceSchema", True)
    return reader.schema(schema).csv(path)


def tsv_with_header(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated records whose first line names the columns (S2); all values are strings."""
    return spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)


def csv_quoted(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with a header and line ends inside values."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def category_table(spark: SparkSession, base: str, fields: list[str], urls: DataFrame | None = None, json: dict[str, str] | None = None) -> DataFrame:
    """The category family ``<base>`` and ``<base>.<field>`` joined by url (S3); only ``urls`` if given; json: field -> its type."""
    out = tsv(spark, base, ["url", "category"])
    if urls is not None:
        out = out.join(urls.select("url").distinct(), "url", "left_semi")
    for f in fields:
        part = tsv(spark, f"{base}.{f}", ["url", f])
        if json and f in json:
            part = part.withColumn(f, F.from_json(f, json[f]))
        out = out.join(part, "url", "left")
    return out


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """key, value, surface (S4); files of two columns have null surfaces."""
    return tsv(spark, path, ["key", "value", "surface"])


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """id, word, tf, semantic vector."""
    v = tsv(spark, path, ["id", "word", "tf", "semantic"])
    return v.select(F.col("id").cast("int").alias("id"), "word", F.col("tf").cast("long").alias("tf"), F.from_json("semantic", "map<string,double>").alias("semantic"))


def ngram_counts(spark: SparkSession, path: str, least: int, form: Column | None = None) -> DataFrame:
    """ngram, n of at least ``least``, counts of equal normal forms summed."""
    rows = tsv(spark, path, ["ngram", "n"]).filter(F.col("n").cast("long") >= least)
    return rows.groupBy((F.col("ngram") if form is None else form).alias("ngram")).agg(F.sum(F.col("n").cast("long")).alias("n"))


def xml_rows(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Elements of XML files as rows."""
    return spark.read.format("xml").option("rowTag", row).load(path)


def capped_content(content: Column | str) -> Column:
    """Content, or the marks for none and too much."""
    c = F.col(content) if isinstance(content, str) else content
    return F.when(c.isNull(), FAILED).when(F.length(c) > MAX_CONTENT, TOO_LARGE).otherwise(F.regexp_replace(c, r"[\t\r\n]", " "))


def in_links(edges: DataFrame, most: int = 0) -> DataFrame:
    """dst and its sources in order, at most ``most`` if that isn't 0."""
    from pyspark.sql import Window as W

    e = edges.select("src", "dst").distinct()
    if most:
        e = e.withColumn("_k", F.row_number().over(W.partitionBy("dst").orderBy("src"))).filter(F.col("_k") <= most)
    return e.groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("sources"))


def embeddings(df: DataFrame, vector: str) -> DataFrame:
    """Vectors at length 1 (S19); zero vectors stay."""
    n = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    return df.withColumn(vector, F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(F.col(vector).cast("array<double>")))


def sequence_counts(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """Count of each asked (model, ngram), 0 if it is not there; the total of the model for an empty one."""
    total = counts.groupBy("model").agg(F.sum("n").alias("n")).select("model", F.lit("").alias("ngram"), "n")
    return asked.join(counts.select("model", "ngram", "n").unionByName(total), ["model", "ngram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
