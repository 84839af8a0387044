"""Reading message CSV files, taxonomies and metric files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from replyforge.functions.numbers import parse_flag, parse_id
from replyforge.schemas import RAW_MESSAGES
from replyforge.sources.taxonomy import entries

_CORRUPT = "_corrupt_record"
# Without columnPruning=false a narrow select would hide lines that do not fit.
CSV_OPTIONS = {
    "header": "true", "multiLine": "true", "quote": '"', "escape": '"', "columnPruning": "false",
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table as Spark splits it."""
    return spark.read.parquet(path)


# Most bytes of files that one task of a ``spread`` scan works on.
TASK_BYTES = 16 << 20


def spread(df: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """A scan dealt over all cores, and over tasks of at most ``task_bytes``, where its
    files give fewer tasks.

    A file with one row group is one task, however long its texts take, and what
    a task counts grows with what it reads; a table of enough tasks is returned
    as it is.  Only for scans: asking a plan with exchanges for its tasks would
    run them.
    """
    tasks = tasks_for(df, task_bytes)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def tasks_for(scan: DataFrame, task_bytes: int) -> int:
    """Tasks that give each at most ``task_bytes`` of the files; no fewer than cores."""
    files = scan.select("_metadata.file_path", "_metadata.file_size").distinct()
    whole = files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("n")).first()["n"]
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-whole // task_bytes))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType = RAW_MESSAGES
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of a CSV file or folder, all columns as text.

    A line with too many fields is rejected whole, as (file, line, n_fields,
    reason); one with too few keeps its fields and gets NULLs.  Messages contain newlines, so files are parsed
    whole: keep them many and moderate, and hand Parquet to later jobs.
    """
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    raw = spark.read.options(**CSV_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
    table = raw.schema(wide).csv(path).select("*", F.col("_metadata.file_name").alias("_file"))
    # Only lines that did not fit are looked at again, with one field to spare.
    spare = T.StructType([*schema.fields, T.StructField("_extra", T.StringType())])
    again = F.from_csv(_CORRUPT, spare.simpleString()[len("struct<"):-1].replace(":", " "),
                       {"quote": '"', "escape": '"'})
    overfull = F.col(_CORRUPT).isNotNull() & again["_extra"].isNotNull()
    names = schema.fieldNames()
    # Spark refuses to read the corrupt column alone; always true, but not foldable.
    some_field = F.coalesce(F.length(names[0]), F.lit(0)) >= 0
    return (
        table.where(~overfull & some_field).select(*names),
        table.where(overfull & some_field).select(
            F.col("_file").alias("file"), F.col(_CORRUPT).alias("line"),
            field_count(F.col(_CORRUPT)).alias("n_fields"),
        ).withColumn(
            "reason", F.concat(F.lit("too many fields: "), F.col("n_fields").cast("string"),
                               F.lit(f" instead of {len(names)}")),
        ),
    )


def field_count(line: Column) -> Column:
    """Fields of a CSV record: separators outside quotes, plus one."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).cast("long")


def read_in_order(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a CSV export with ``row_no``, their place in file order, from 1.

    Files follow each other by name, rows as they stand in their file.  Files are
    numbered apart, each in a task, and shifted by the sizes of those before.
    """
    table = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at")
    )
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = table.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))  # one row per file
    )
    nth = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    return table.withColumn("_nth", nth).join(F.broadcast(before), "_file").select(
        (F.col("_before") + F.col("_nth")).alias("row_no"), *schema.fieldNames()
    )


def typed_messages(raw: DataFrame) -> DataFrame:
    """Text columns to message types; unparseable ids and flags become NULL."""
    return raw.select(
        parse_id(F.col("tweet_id")).alias("tweet_id"),
        "author_id",
        parse_flag(F.col("inbound")).alias("inbound"),
        "created_at",
        "text",
        "response_tweet_id",
        parse_id(F.col("in_response_to_tweet_id")).alias("in_response_to_tweet_id"),
    )


def read_messages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(typed messages, rejected lines)."""
    rows, rejects = read_csv(spark, path)
    return typed_messages(rows), rejects


def peek_schema(spark: SparkSession, path: str, rows: int | None = None) -> T.StructType:
    """Column types a CSV suggests: from all rows, or from the first ``rows`` if asked."""
    head = spark.read.options(**CSV_OPTIONS).csv(path)
    if rows is not None:
        head = head.limit(rows)
    fields = []
    for name in head.columns:
        value = F.col(name)
        fields.append(
            F.when(F.count_if(value.isNotNull() & value.try_cast("bigint").isNull()) == 0, "bigint")
            .when(F.count_if(value.isNotNull() & value.try_cast("double").isNull()) == 0, "double")
            .when(
                F.count_if(value.isNotNull() & ~F.lower(value).isin("true", "false")) == 0,
                "boolean",
            )
            .otherwise("string")
            .alias(name)
        )
    found = head.agg(*fields).first()
    return T.StructType(
        [T.StructField(n, T._parse_datatype_string(found[n])) for n in head.columns]
    )


def read_taxonomy(spark: SparkSession, path: str, section: str = "intents") -> DataFrame:
    """(position, name) of the intents in a taxonomy YAML file (one small file).

    Read on the driver, from any store that Spark reads; ``taxonomy.read`` scans
    folders of them in tasks.
    """
    (text,) = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    names = [(i, str(e["name"])) for i, e in enumerate(entries(text, section, path))]
    return spark.createDataFrame(names, "position int, name string")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1) out of a nested metrics JSON file."""
    table = spark.read.json(path, multiLine=True)
    return table.select(
        F.col("accuracy"),
        F.col("macro_avg").getField("f1-score").alias("macro_f1"),
        F.col("weighted_avg").getField("f1-score").alias("weighted_f1"),
    )
