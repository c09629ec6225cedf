"""File readers: tables, raster layers, requests and tuner documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siterank.constants import LAYERS, RECORD_FIELDS
from siterank.operators.clean import is_json, trim_headers

RECORD_SCHEMA = T.StructType([T.StructField(f, T.DoubleType()) for f in RECORD_FIELDS])

_METRIC = T.StructType([
    T.StructField("direction", T.StringType()),
    T.StructField("observations", T.ArrayType(T.StructType([
        T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("step", T.LongType())]))),
])
TRIAL_SCHEMA = T.StructType([
    T.StructField("trial_id", T.StringType()),
    T.StructField("hyperparameters", T.StructType([
        T.StructField("space", T.ArrayType(T.StructType([
            T.StructField("class_name", T.StringType()),
            T.StructField("config", T.MapType(T.StringType(), T.StringType()))]))),
        T.StructField("values", T.MapType(T.StringType(), T.StringType()))])),
    T.StructField("metrics", T.StructType([T.StructField("metrics", T.MapType(T.StringType(), _METRIC))])),
    T.StructField("score", T.DoubleType()),
    T.StructField("best_step", T.LongType()),
    T.StructField("status", T.StringType()),
])


def csv_scan(spark: SparkSession, path: str | Sequence[str], schema, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV with a given schema."""
    return spark.read.csv(path if isinstance(path, str) else list(path), header=True, schema=schema,
                          encoding=encoding)


def csv_scan_encoding(spark: SparkSession, path: str, schema) -> DataFrame:
    """Header CSV files, each read as UTF-8 or, where any of its lines is not valid UTF-8, as latin-1.

    One plan: files are read as lines, split like any text. A first scan gives a row for each file, its header line and whether it is
    latin-1; it is joined to the lines, which are then decoded and parsed. Lines equal to their file's header are no rows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    files = lines.withColumn("_line", F.monotonically_increasing_id()).groupBy("_file").agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("_latin"),
        # the first line of a file is the first one of its first block
        F.min_by("value", F.struct("_start", "_line")).alias("_header"))
    rows = lines.drop("_start").join(files, "_file").where((F.col("value") != F.col("_header")) & (F.trim("value") != ""))
    text = F.when(F.col("_latin"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))
    ddl = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    return rows.select(F.from_csv(text, ddl).alias("_row")).select("_row.*")


def union_region_files(spark: SparkSession, path: str) -> DataFrame:
    """Parquet tables of regions below ``path`` as one table, by column name; a column that a region lacks is null there.

    One scan: ``region`` comes from folders ``region=<name>``, or is the name of the folder that holds a file.
    """
    rows = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    region = F.try_url_decode(F.regexp_replace(F.regexp_replace(folder, "^region=", ""), r"\+", "%2B"))
    return rows.withColumn("region", region)


def csv_scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as text columns with trimmed names."""
    return trim_headers(spark.read.csv(path, header=True))


def raster_scan(spark: SparkSession, path: str, layers: Sequence[str] | None = None) -> DataFrame:
    """Scanlines partitioned by layer; only the asked layers are read."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("layer").isin(*layers)) if layers else rows


def raster_pixels(scanlines: DataFrame) -> DataFrame:
    """Long form of scanlines: (layer, y, x, value)."""
    return scanlines.select("layer", "y", F.posexplode("pixels").alias("x", "value"))


def layer_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LAYERS), "layer string, name string, file string, unit string, description string")


def decode_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Add the record fields of JSON text and ``_corrupt`` (the text, where it is not a record)."""
    schema = T.StructType([*RECORD_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
                                        "allowSingleQuotes": "false"})
    out = df.select("*", parsed.alias("_r")).select(*df.columns, "_r.*")
    # the parser stops after the first value, so text behind it is tested here
    trailing = F.col(body).isNotNull() & ~is_json(F.col(body))
    return out.withColumn("_corrupt", F.when(trailing, F.col(body)).otherwise(F.col("_corrupt")))


# layout -> where in the path the model's name stands
TRIAL_LAYOUTS = {
    "tuner": r"([^/]+)/[^/]+/[^/]+/trial\.json$",  # <model>/<project>/<trial>/trial.json, as tuners leave it
    "partitioned": r"model=([^/]+)/part-[^/]+$",  # as Spark writes it
    "flat": r"([^/=]+)/(?!(?:build_config|oracle|tuner\d*)\.json$)[^/]+\.json$",  # <model>/<trial>.json
}


def _trial_layout(path: Column) -> tuple[Column, Column]:
    """(layout, model) of a file, by its path alone; null for what is no trial."""
    layout, model = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(TRIAL_LAYOUTS.items()):
        layout = F.when(path.rlike(pattern), F.lit(name)).otherwise(layout)
        model = F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1)).otherwise(model)
    return layout, model


def trial_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, layout, model) of every file under ``path``; those with a null layout are not read by ``trial_scan``."""
    layout, model = _trial_layout(F.col("path"))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("file"), layout.alias("layout"), model.alias("model"))


def trial_scan(spark: SparkSession, path: str) -> DataFrame:
    """Tuner trial documents, one JSON object per line, in any of ``TRIAL_LAYOUTS``.

    The path decides whose trial a file holds; ``trial_files`` lists what is left out.
    """
    docs = (spark.read.schema(TRIAL_SCHEMA).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "{*.json,part-*}").json(path))
    layout, model = _trial_layout(F.col("_metadata.file_path"))
    return docs.where(layout.isNotNull()).select(model.alias("model"), "*")
