"""Frames: keyed messages of captures, from Parquet captures or from an event stream; JSON manifests and CSV tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("vehicle", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("susp_interval", T.ArrayType(T.DoubleType())),
    ]
)
#: Order of event types as captures, and the attack family of each.
FAMILIES = {"view": "benign", "click": "benign", "error": "dos", "signup": "fuzzing", "purchase": "suspension"}
#: Suspension of the purchase captures, in microseconds since 1970: 2024-01-10 to 2024-01-12.
SUSPENSION = (1_704_844_800_000_000, 1_705_017_600_000_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of capture descriptions; vehicles' 'advanced' captures are left out."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).where("family <> 'advanced'")


def read_captures(spark: SparkSession, path: str, manifest: DataFrame, max_manifest: int = 100_000) -> DataFrame:
    """Captures (a Parquet file, or a folder of one, each; columns t, aid, dlc, b0..b7, y) with their manifest entries.

    An entry's file is the file's name; of a folder that ends with .parquet or is a partition (key=value), the folder's. Order within a file becomes seq, from the reader's row
    index. The manifest is broadcast while it is small.
    """
    parts = F.split(F.col("_metadata.file_path"), "/")
    folder = F.element_at(parts, -2)
    raw = spark.read.option("recursiveFileLookup", "true").parquet(path).select(
        F.when(folder.rlike(r"\.parquet$|="), folder).otherwise(F.element_at(parts, -1)).alias("file"),
        F.col("_metadata.row_index").alias("seq"),
        F.round(F.col("t") * 1e6).cast("long").alias("us"),
        F.col("aid").cast("int"),
        F.col("dlc").cast("int"),
        F.array(*[F.col(f"b{i}").cast("int") for i in range(8)]).alias("b"),
        F.col("y").cast("int"),
    )
    side = manifest.select(
        F.element_at(F.split("file", "/"), -1).alias("file"),
        "vehicle",
        F.col("name").alias("capture"),
        "family",
        (F.col("susp_interval")[0] * 1e6).cast("long").alias("s0"),
        (F.col("susp_interval")[1] * 1e6).cast("long").alias("s1"),
    )
    small = manifest.limit(max_manifest + 1).count() <= max_manifest
    return raw.join(F.broadcast(side) if small else side, "file").drop("file")


def repaired(y: Column, data_hex: Column) -> Column:
    """A label whose frame's hex text is malformed becomes 0; null and empty texts leave it."""
    text = F.coalesce(data_hex, F.lit(""))
    return F.when((y == 1) & (~text.rlike("^[0-9A-Fa-f]*$") | (F.length(text) % 2 != 0)), 0).otherwise(y)


def attack_slice(frames: DataFrame, margin: int) -> DataFrame:
    """Of captures with attacked frames, the rows from margin before the first to margin after the last; others whole."""
    attacked = frames.where("y = 1").groupBy("capture").agg(F.min("seq").alias("_a"), F.max("seq").alias("_z"))
    kept = F.col("_a").isNull() | F.col("seq").between(F.col("_a") - margin, F.col("_z") + margin)
    return frames.join(attacked, "capture", "left").where(kept).select(*frames.columns)


def relabelled(attack: DataFrame, original: DataFrame, columns: list[str]) -> DataFrame:
    """Labels each frame of a log 1 where the attack-free original has no frame left to match it (a multiset difference).

    The i-th of equal frames matches the original's i-th of them.
    """
    w = Window.partitionBy(*columns).orderBy("seq")
    ours = attack.withColumn("_i", F.row_number().over(w))
    theirs = original.withColumn("_i", F.row_number().over(w)).select(*columns, "_i", F.lit(0).alias("_m"))
    return ours.join(theirs, [*columns, "_i"], "left").withColumn("y", F.coalesce("_m", F.lit(1))).drop("_m", "_i")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as frames of three vehicles, five captures each. Times are whole microseconds."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("v"), F.col("user_id") % 3).alias("vehicle"),
        "event_type",
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "user_id",
        k.alias("k"),
    )
    strange = (F.col("event_type") == "signup") & (F.col("k") < 3)
    stopped = F.col("event_type") == "purchase"
    return (
        rows.withColumn("dlc", F.col("k") % 9)
        .withColumn("b", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < F.col("dlc"), ((F.col("seq") * (i + 3) + F.col("k")) % 256).cast("int")).otherwise(-1)))
        .select(
            "vehicle",
            F.concat_ws("_", "vehicle", "event_type").alias("capture"),
            family[F.col("event_type")].alias("family"),
            "seq",
            "us",
            F.when(strange, 900 + F.col("k")).otherwise(F.col("user_id") % 40 + 20 * (F.col("user_id") % 3)).cast("int").alias("aid"),
            "dlc",
            "b",
            F.when(F.col("event_type").isin("error", "signup") & (F.col("k") < 3), 1).otherwise(0).alias("y"),
            F.when(stopped, F.lit(SUSPENSION[0])).alias("s0"),
            F.when(stopped, F.lit(SUSPENSION[1])).alias("s1"),
        )
    )
