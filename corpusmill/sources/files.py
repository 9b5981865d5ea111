"""Reading and writing the pipeline's files: JSON lines, CSV, section folders, summaries, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The columns of the logical tables.
SCHEMAS = {
    "documents": "doc_id string, course_id string, title string, source_type string, license string, source_url string, download_date string, text string",
    "chunks": "chunk_id string, doc_id string, course_id string, section string, chunk_index int, text string",
    "questions": "qid string, course_id string, language string, question_type string, question_text string, reference_answer string",
    "gold_labels": "qid string, gold_doc_ids array<string>, gold_chunk_ids array<string>",
    "results": "qid string, system string, language string, ranked_chunks array<struct<chunk_id:string,rank:int,score:double>>",
    "answers": "qid string, system string, language string, retrieved_chunk_ids array<string>, answer string, abstained boolean, generation_failure string, valid_citation_count int",
    "annotations": "qid string, label string, duplicate_group string",
}


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines, a file, folder or glob; blank lines are skipped, a broken one raises when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds part files; each write commits as a whole."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every column a string, quotes doubled, line breaks inside quotes."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path).fillna("")


def write_csv(df: DataFrame, path: str) -> bool:
    """False, and nothing written, if there are no rows. Booleans are written as true and false."""
    if df.isEmpty():
        return False
    flat = df.select(*[F.col(f.name).cast("string").alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    return True


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """section_slug (the file's stem), text: every Markdown file of a folder, whole."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("section_slug"), F.col("value").alias("text"))


def summary_json(values: DataFrame) -> DataFrame:
    """One JSON text per row of a small table of figures."""
    return values.select(F.to_json(F.struct("*")).alias("json"))


def counts_map(df: DataFrame, column: str) -> Column:
    """Aggregate: a map from value to count, out of a table (value, count) that has been counted already."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column), F.col("count")))))


def write_vectors(df: DataFrame, path: str) -> None:
    """The vector table is the index of an exact search."""
    df.write.mode("overwrite").parquet(path)


def read_config(path: str, defaults: dict | None = None) -> dict:
    """Flat `key: value` lines of a YAML file; {} for an empty one. Driver side."""
    out = dict(defaults or {})
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.split(" #")[0].strip()
            if not line or line[0] == "#" or ":" not in line:
                continue
            key, _, value = line.partition(":")
            value = value.strip().strip("\"'")
            out[key.strip()] = int(value) if value.lstrip("-").isdigit() else float(value) if value.replace(".", "", 1).lstrip("-").isdigit() else {"true": True, "false": False}.get(value.lower(), value)
    return out


def with_positions(df: DataFrame, order: list[str], name: str = "_pos") -> DataFrame:
    """`df` with dense positions from 0 in the order of columns.

    Rows are range-partitioned and sorted; the sizes of the partitions before give each its offset, so no
    task sees all rows."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id() % F.lit(1 << 33))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")
