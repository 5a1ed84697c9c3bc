"""File sources and sinks.

Writers never force a single output file: ``single_file=True`` (the reference's ``coalesce(1)``)
funnels all rows through one task and is only meant for small exports.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# microsecond timestamps in JSON text (Spark's default pattern keeps milliseconds only)
_TS_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
             mode: str = "PERMISSIVE") -> DataFrame:
    """A1: CSV with a header line and a declared schema. Binding is by position: the declared
    names replace whatever the header says (``enforceSchema`` stays at Spark's default)."""
    return spark.read.schema(schema).option("header", header).option("mode", mode).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite",
              single_file: bool = False) -> str:
    """A2: CSV with header, overwrite by default."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", header).csv(path)
    return path


def parse_json_column(df: DataFrame, col: str, schema: T.StructType, corrupt_col: str | None = None) -> DataFrame:
    """A3: JSON text column -> typed columns with a declared schema (no per-batch inference).
    Lines that do not parse give nulls; with ``corrupt_col`` the raw text of such lines is kept."""
    if corrupt_col:
        schema = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType(), True)])
        parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_col})
    else:
        parsed = F.from_json(F.col(col), schema)
    return df.withColumn("_json", parsed).select(*[c for c in df.columns if c != col], "_json.*")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType,
                    corrupt_col: str = "_corrupt_record") -> DataFrame:
    """A3: JSON-lines files with a declared schema; unparsable lines land in ``corrupt_col``."""
    full = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType(), True)])
    return (spark.read.schema(full).option("mode", "PERMISSIVE").options(**_TS_OPTIONS)
            .option("columnNameOfCorruptRecord", corrupt_col).json(path))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """One JSON object per line (the search history export)."""
    df.write.mode(mode).options(**_TS_OPTIONS).json(path)
    return path


def save_model(model: PipelineModel, path: str) -> str:
    """Save a fitted pipeline, overwriting."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline."""
    return PipelineModel.load(path)


def read_matrix(spark: SparkSession, path: str, n_cols: int) -> DataFrame:
    """A10: headerless numeric CSV -> (row_idx, values array<double>), rows in the order of the file's lines.
    A matrix is one file: lines of several files have no order of their own, so they are refused."""
    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType(), True) for i in range(n_cols)])
    raw = spark.read.schema(schema).option("header", False).csv(path)
    if len(raw.inputFiles()) > 1:
        raise ValueError(f"{path} has more than one file; a matrix is read from one")
    # a split's rows keep their order, and splits of one file are ordered by where they begin
    return raw.select(
        (F.col("_metadata.file_block_start") * 1_000_000_000 + F.monotonically_increasing_id() % (1 << 33)).alias("row_idx"),
        F.array(*[F.col(f"c{i}") for i in range(n_cols)]).alias("values"),
    )
