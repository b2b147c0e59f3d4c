"""File formats of the original pipeline as Spark readers/writers.

Every reader takes a declared schema (no inference).  Writers produce folders
of part files, so no dataset passes through the driver or one task.
"""

from __future__ import annotations

import ast
import json
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW_DICT_SCHEMA = ("asin STRING, doc_id BIGINT, helpful ARRAY<BIGINT>, overall DOUBLE, "
                      "reviewText STRING, reviewTime STRING, unixReviewTime BIGINT, reviewerName STRING")


def _literals(batches):
    """JSON objects -> Python dict literals, one per line."""
    for batch in batches:
        yield pa.RecordBatch.from_pylist(
            [{"value": repr(json.loads(line))} for line in batch.column(0).to_pylist()],
            pa.schema([("value", pa.string())]))


def _objects(batches, permissive: bool):
    """Python dict literals -> (JSON object, corrupt line)."""
    schema = pa.schema([("value", pa.string()), ("_corrupt_record", pa.string())])
    for batch in batches:
        out = []
        for line in batch.column(0).to_pylist():
            try:
                record = ast.literal_eval(line.strip())
                if not isinstance(record, dict):
                    raise ValueError("not a dict")
                out.append({"value": json.dumps(record), "_corrupt_record": None})
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError) as why:
                if not permissive:
                    raise ValueError(f"not a review record ({why}): {line[:200]!r}") from why
                out.append({"value": None, "_corrupt_record": line})
        yield pa.RecordBatch.from_pylist(out, schema)


def write_review_dicts(df: DataFrame, path: str) -> None:
    """Gzip text, one Python-dict literal per line ({'asin': 'x', 'helpful': [1, 2], ...});
    nulls are None, and texts may hold any quotes and line ends."""
    js = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(js.alias("value")).mapInArrow(_literals, "value string").write.mode("overwrite") \
        .option("compression", "gzip").text(path)


def read_review_dicts(spark: SparkSession, path: str, schema: str = REVIEW_DICT_SCHEMA,
                      mode: str = "FAILFAST") -> DataFrame:
    """The lines are read as Python literals, never evaluated as code, and blank ones are
    skipped.  A line that is no record stops the read; with ``mode="PERMISSIVE"`` it becomes a row
    of nulls with the line in ``_corrupt_record``.  A gzip file is one split, so the lines
    are spread over the cluster before they are parsed."""
    permissive = mode.upper() == "PERMISSIVE"
    lines = spark.read.text(path).filter(F.trim("value") != "")
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = lines.mapInArrow(partial(_objects, permissive=permissive), "value string, _corrupt_record string")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE" if permissive else "FAILFAST"})
    return found.select(row.alias("r"), "_corrupt_record").select(
        "r.*", *(["_corrupt_record"] if permissive else []))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S2."""
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV with header, quotes escaped by doubling, spaces kept."""
    (df.write.mode("overwrite").option("header", header).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, multi_line: bool = True) -> DataFrame:
    """S3: CSV with header; quoted fields may span lines.  That makes every file one task; where no field holds a
    line end, ``multi_line=False`` lets Spark split large files."""
    return (spark.read.schema(schema).option("header", header).option("multiLine", multi_line)
            .option("quote", '"').option("escape", '"').csv(path))


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str,
                header: bool = False) -> DataFrame:
    """Train / val / test files to one table with a ``split`` column."""
    out = None
    for split, p in paths.items():
        d = read_csv(spark, p, schema, header).withColumn("split", F.lit(split))
        out = d if out is None else out.unionByName(d)
    return out


def write_by_product(df: DataFrame, path: str, key: str = "asin") -> None:
    """One parquet folder per product (or dataset).

    Rows are dealt by ranges of (key, hash of the row): few files a product, and a
    large product is split over several tasks."""
    rest = [c for c in df.columns if c != key]
    df = df.repartitionByRange(F.col(key), F.xxhash64(*rest)) if rest else df
    df.write.mode("overwrite").partitionBy(key).parquet(path, compression="zstd")


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S6 / S7 / S8 between stages."""
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.parquet(path)


def write_word_vectors(df: DataFrame, path: str, word: str = "word", vec: str = "vec") -> None:
    """Word-vector text file: the word then its components, space separated."""
    line = F.concat_ws(" ", F.col(word), F.array_join(F.col(vec).cast("array<string>"), " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word x1 x2 ...`` lines -> (word, vec ARRAY<DOUBLE>)."""
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).select(
        F.element_at(parts, 1).alias("word"),
        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("double")).alias("vec"))
