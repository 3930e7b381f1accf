"""Reading the panel's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.schema import CATALOGUE_SCHEMA, COVARIATE_SCHEMA, NORM_SCHEMA, OBSERVATION_SCHEMA
from panelcast.session import cut

SEALED = "test"


def _nan_to_null(df: DataFrame) -> DataFrame:
    """Unknown is null everywhere; files may say NaN."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def _named(path, suffix: str):
    """The series in a file name; paths come URL-encoded."""
    return F.url_decode(F.replace(F.regexp_extract(path, rf"([^/=]+){suffix}\.csv", 1), F.lit("+"), F.lit("%2B")))


# Names that end in ``_hourly.csv`` but not in ``_era5_hourly.csv``: weather lies beside and is not even listed.
NOT_WEATHER = "{*[^5],*[^a]5,*[^r]a5,*[^e]ra5,*[^_]era5,5,a5,ra5,era5}_hourly.csv"


def read_observations(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files (or folders of parts) named ``<series>_hourly.csv``; the name gives the series.

    Weather files lie in the same folder; the pattern leaves them out.
    """
    df = (
        spark.read.schema(OBSERVATION_SCHEMA).option("header", True).option("enforceSchema", False)
        .csv(f"{folder}/{NOT_WEATHER}")
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    name = _named(F.col("_path"), "_hourly")
    return _nan_to_null(df.withColumn("series_id", name)).select("series_id", *[f.name for f in OBSERVATION_SCHEMA])


def _plain_path(path):
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_covariates(spark: SparkSession, folder: str) -> DataFrame:
    """Weather tables, each file read by its own header: columns may stand in any order and further ones (a raw accumulation
    ``tp_m``) may be there in some files only; an absent covariate is an error that names the file.

    Files are listed once. The driver gets a row for each kind of header; which file has which is a table of Spark. The header
    is the line that names the column ``slot_utc``; a file with lines but without it is an error.
    """
    wanted = [f.name for f in COVARIATE_SCHEMA]
    lines = spark.read.text(f"{folder}/*_era5_hourly.csv").select("value", F.col("_metadata.file_path").alias("path")).filter("value <> ''")
    heads = lines.groupBy("path").agg(F.max(F.when(F.col("value").contains("slot_utc"), F.col("value"))).alias("head"))
    heads = cut(heads)
    kinds = {r["head"]: r["path"] for r in heads.groupBy("head").agg(F.min(_plain_path(F.col("path"))).alias("path")).collect()}
    if not kinds:
        raise FileNotFoundError(f"no weather rows in {folder}")
    if None in kinds:
        raise ValueError(f"no header with slot_utc in {kinds[None]}")
    places = {}
    for head, path in sorted(kinds.items()):
        header = [c.strip().strip('"').lstrip("\ufeff") for c in head.split(",")]
        absent = [c for c in wanted if c not in header]
        if absent:
            raise ValueError(f"missing columns: {absent} in {path}")
        places[head] = header
    width = max(map(len, places.values()))
    cells = F.from_csv("value", ", ".join(f"_{i} string" for i in range(width))).alias("_s")
    rows = lines.join(heads, "path").filter("value <> head").select("path", "head", cells)

    def column(f):
        at = F
        for head, header in places.items():
            at = at.when(F.col("head") == head, F.col(f"_s._{header.index(f.name)}"))
        return at.cast(f.dataType).alias(f.name)

    return _nan_to_null(rows.select(_named(F.col("path"), "_era5_hourly").alias("series_id"), *[column(f) for f in COVARIATE_SCHEMA]))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOGUE_SCHEMA).option("header", True).csv(path)


def catalogue_splits(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("series_id", "split")


def read_split(spark: SparkSession, folder: str, split: str, unsealed: bool = False) -> DataFrame:
    """One split of the sample store (a pruned partition).  The test split stays sealed unless asked for."""
    if split == SEALED and not unsealed:
        raise PermissionError("the test split is sealed; pass unsealed=True for a declared evaluation")
    return spark.read.parquet(f"{folder}/samples").filter(F.col("split") == split)


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """All splits, for checks of the store itself."""
    return spark.read.parquet(f"{folder}/samples")


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/metadata")


def read_store_series(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/series")


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.option("header", True).schema(
        "sample_idx bigint, series_id string, split string, input_start_utc timestamp_ntz, "
        "target_end_utc timestamp_ntz, target_mean_frp double, target_max_frp double").csv(path)
    return df if split is None else df.filter(F.col("split") == split)


def read_norm_params(spark: SparkSession, path: str) -> DataFrame:
    """(feature, mean, std) from a ``{feature: {mean, std}}`` JSON file or a table of the same."""
    if path.endswith(".json"):
        m = "map<string, struct<mean: double, std: double>>"
        text = spark.read.option("wholetext", True).text(path)
        return text.select(F.explode(F.from_json("value", m)).alias("feature", "p")).select("feature", "p.mean", "p.std")
    return spark.read.schema(NORM_SCHEMA).parquet(path)


def value_norm(params: DataFrame, feature: str = "frp_lag_1h") -> tuple[float, float]:
    """Mean and deviation used to undo the scaling of the persistence prior."""
    row = params.filter(F.col("feature") == feature).first()
    if row is None:
        raise KeyError(feature)
    return row.mean, row.std


HISTORY_FILE_SCHEMA = (
    "seed int, best_epoch int, best_val_SS_paper double, best_per_event map<string, double>, wall_s double, "
    "history array<struct<epoch: int, val_SS_paper: double, per_event: map<string, double>>>"
)


def read_runs(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Run results (bare NaN allowed): one nested document per file, or one per line."""
    return spark.read.schema(HISTORY_FILE_SCHEMA).option("multiLine", one_per_file).json(path)


def run_history(runs: DataFrame) -> DataFrame:
    return runs.select("seed", F.explode("history").alias("h")).select("seed", "h.epoch", "h.val_SS_paper", "h.per_event")


def prediction_files(spark: SparkSession, folder: str) -> DataFrame:
    """(seed, path) of the files ``seed_<number>_valpreds.parquet`` (or folders of parts); only names are read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path")
    seed = F.regexp_extract("path", r"seed_(\d+)_valpreds\.parquet", 1)
    return names.filter(seed != "").select(seed.cast("int").alias("seed"), "path")


def read_predictions(spark: SparkSession, folder: str, seeds) -> DataFrame:
    """Long forecasts of the wanted seeds, from one file (or folder) per seed. Which seeds have files is settled before anything
    is read: a wanted seed without one is an error."""
    from panelcast.plans.ensembles import require_seeds

    seeds = sorted({int(x) for x in seeds})
    require_seeds(prediction_files(spark, folder), seeds)
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    seed = F.regexp_extract(F.col("_metadata.file_path"), r"seed_(\d+)_valpreds\.parquet", 1)
    return df.withColumn("seed", F.when(seed != "", seed).cast("int")).filter(F.col("seed").isin(seeds))
