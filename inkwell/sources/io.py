"""Sources and sinks on Spark's own readers and writers, so any file system that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SENTENCE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a fixed schema; fields that do not parse are null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSS]X")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentence documents (one JSON object per file); broken files are dropped, both names of the lines are read, NaN
    becomes null."""
    df = spark.read.json(path, schema=SENTENCE, multiLine=True, mode="DROPMALFORMED", allowNonNumericNumbers=True)
    df = df.withColumn("lines", F.coalesce("physical_lines", "lines")).drop("physical_lines")
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def read_images(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Image files below a folder, with grade (the number in the parent folder, -1 without) and id (the file's stem)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(jpe?g|png)$"))
    grade = F.regexp_extract(F.element_at(F.split("path", "/"), -2), r"(\d+)", 1)
    out = df.select("path", F.when(grade == "", -1).otherwise(grade.try_cast("int")).alias("grade"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("student_id"), "length", *(["content"] * with_content))
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrites only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


#: Short names of the modelled tables.
ALIASES = {"hindi": "modeled_hindi", "english": "modeled_english", "combined": "modeled_combined", "student": "student_table", "student_level": "student_table"}


def load_dataset(spark: SparkSession, folder: str, name: str, needed: tuple[str, ...] = ("student_id", "label")) -> DataFrame:
    """A modelled table by alias or path; it must have the needed columns."""
    path = f"{folder}/{ALIASES[name]}.parquet" if name in ALIASES else name
    df = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def append_missing(cache: DataFrame | None, rows: DataFrame, key: str, path: str) -> None:
    """Add the rows whose key the cache at path lacks, one row of each key; what is there stays as it is."""
    new = rows.dropDuplicates([key])
    (new if cache is None else new.join(cache.select(key), key, "left_anti")).write.mode("append").parquet(path)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def read_arrays(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """NPZ files with parallel arrays `key` and `value`: a row of (key, value) for each element, value a vector."""

    def read(parts):  # noqa: ANN001, ANN202
        import io

        import numpy as np
        import pandas as pd

        for part in parts:
            for content in part["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pd.DataFrame({"key": z[key].astype(str), "value": [np.atleast_1d(v).astype(float).tolist() for v in z[value]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "key string, value array<double>")


def write_arrays(df: DataFrame, path: str) -> None:
    """Arrays are columns of Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_by_suffix(df: DataFrame, path: str) -> None:
    """JSON records for .json, else CSV with a header."""
    df.write.mode("overwrite").json(path) if path.endswith(".json") else write_csv(df, path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A flat `key: value` configuration; values are JSON where they parse, else text. Comments begin with #."""
    import json

    out = {}
    for row in spark.read.text(path).collect():
        line = row["value"].split(" #")[0].rstrip()
        name, found, value = line.partition(":")
        if found and not line.startswith("#"):
            try:
                out[name.strip()] = json.loads(value)
            except ValueError:
                out[name.strip()] = value.strip()
    return out


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report table of a small aggregate; more than `most` rows are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: aggregate first")
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4g}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
