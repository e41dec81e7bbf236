"""Result tables and documents: Parquet, CSV with resuming, JSON lines, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of its schema where nothing has been written yet; other errors stay errors."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def append_missing(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the table lacks and returns them; run again after a crash, it goes on."""
    spark = df.sparkSession
    if _exists(spark, path):
        done = spark.read.parquet(path).select(key)
        df = df.join(done, df[key].eqNullSafe(done[key]), "left_anti").select(*df.columns)
    df.write.mode("append").parquet(path)
    return df


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report of at most ``most`` rows of a small table."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"
