"""The stages of the bus pipeline over the event frames, each built from the one before."""

from __future__ import annotations

import threading
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.operators import evaluation, exact, messages, profile, rules, splits, windows
from busloom.settings import SPARSE, Settings
from busloom.sources.frames import event_frames
from busloom.sources.sinks import scratch, write_store

KEYS = ["target", "scope", "capture", "family", "widx", "y", "is_calib", "is_eval"]


class Bus:
    """Lazily built DataFrames of one input folder. The feature store and the rule scores are written when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = SPARSE):
        self.spark, self.s = spark, settings
        self.frames = event_frames(spark, sf_dir)
        self._made: dict[str, DataFrame] = {}
        self._lock = threading.RLock()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not hasattr(type(self), f"make_{name}"):
            raise AttributeError(name)
        with self._lock:  # jobs that run side by side make each once
            if name not in self._made:
                self._made[name] = getattr(self, f"make_{name}")()
            return self._made[name]

    def kept(self, name: str, make) -> DataFrame:
        """What make() gives, made once under this name."""
        with self._lock:
            if name not in self._made:
                self._made[name] = make()
            return self._made[name]

    def make_ids(self):
        return profile.id_profile(self.frames, self.s)

    def make_vehicles(self):
        return profile.vehicle_profile(self.frames)

    def make_messages(self):
        """Written once: windows, identifier counts and arrivals read it, each its columns alone."""
        made = messages.per_message(self.frames, self.ids)
        return write_store(made, scratch(self.spark, "messages")).select(made.columns)

    def make_windows(self):
        return windows.windowed(self.messages, self.s)

    def make_features(self):
        return windows.features_b(self.messages, self.ids, self.vehicles, self.s)

    def make_raw(self):
        return windows.features_a_raw(self.messages, self.s)

    def make_fs_a(self):
        """The identifier-coupled table of every target with labels and quarters, written once by target."""
        made = windows.features_a(self.raw, self.messages, self.pooled, self.s).join(self.labelled, windows.WINDOW)
        return write_store(made, scratch(self.spark, "features-a"), "target").select(made.columns)

    def make_fs_a_rank(self):
        made = windows.features_a_rank(self.raw, windows.histogram(self.messages, self.vocabulary, self.s)).join(self.labelled, windows.WINDOW)
        return write_store(made, scratch(self.spark, "features-a-rank")).select(made.columns)

    def make_vocabulary(self):
        return profile.vocabulary(self.frames, self.s.vocabulary)

    def make_pooled(self):
        return profile.pooled_vocabulary(self.frames, self.s.vocabulary)

    def make_labelled(self):
        return windows.quarters(windows.labels(self.windows))

    def make_seconds(self):
        return windows.window_seconds(self.frames, self.s)

    def make_split(self):
        """Features with labels, quarters and the cross-vehicle flags: the feature store, written once by vehicle."""
        joined = self.features.join(splits.cross(self.labelled), windows.WINDOW)
        return write_store(joined, scratch(self.spark, "features")).select(joined.columns)

    def make_long(self):
        features = list(dict.fromkeys([*rules.HIGH, *rules.TWO_SIDED, *rules.TWO_SIDED34]))
        return rules.melted(self.split, [*windows.WINDOW, "y", "q", "is_calib", "is_eval"], features)

    def make_fitted_on(self):
        """What each target's rules are fitted on: the fleet's attack-free windows, and the target's calibration windows."""
        fleet = splits.pools(self.long.where("y = 0")).select("target", F.lit("fleet").alias("scope"), "feature", "x")
        own = self.long.where("is_calib").select(F.col("vehicle").alias("target"), F.lit("target").alias("scope"), "feature", "x")
        return fleet.unionByName(own)

    def make_reference(self):
        return rules.reference(self.fitted_on, ["target", "scope"])

    def make_z(self):
        mine = self.long.withColumnRenamed("vehicle", "target").drop("q")
        return mine.join(self.reference, ["target", "feature"]).withColumn("z", (F.col("x") - F.col("med")) / F.col("scale")).drop("med", "scale")

    def make_scores(self):
        """Rule scores to six places, written once: what thresholds and rankings see doesn't hang on an engine's last bits."""
        scores = named(rules.rule_scores(self.z, KEYS)).withColumn("score", exact.rounded(F.col("score"), 6))
        return write_store(scores, scratch(self.spark, "rule-scores"), "target").select(scores.columns)

    def make_quantile_rows(self):
        """The windows to score, and those that the quantile union is fitted on (is_ref)."""
        fitted = rules.z_scores(self.fitted_on, self.reference, ["target", "scope"]).withColumn("is_ref", F.lit(True))
        return self.z.withColumn("is_ref", F.lit(False)).unionByName(fitted, allowMissingColumns=True)

    def make_quantile_scores(self):
        return named(rules.quantile_scores(self.quantile_rows, KEYS, ["target", "scope"]).withColumn("model", F.lit("Rule:CombinedQ")))

    def make_points(self):
        calib = self.scores.where("is_calib").groupBy("target", "model").agg(F.count(F.lit(1)).alias("n_calib"))
        return evaluation.operating_points(calib.join(self.seconds.select(F.col("vehicle").alias("target"), "win_seconds"), "target"))

    def make_limits(self):
        return evaluation.thresholds(self.scores.where("is_calib"), self.points)

    def make_predicted(self):
        return evaluation.alarms(self.scores.where("is_eval"), self.limits)

    def make_confusion(self):
        return evaluation.confusion(self.predicted)

    def make_ranking(self):
        return evaluation.ranking(self.scores.where("is_eval"))


_KNOWN: dict[tuple, Bus] = {}


def bus(spark: SparkSession, sf_dir: str) -> Bus:
    """The application's one Bus of an input, so that its feature store serves every query; changed files make a new one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/events.parquet")
    state = files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first()  # of the listing, no content is read
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _KNOWN:
        _KNOWN[key] = Bus(spark, sf_dir)
    return _KNOWN[key]


def named(scores: DataFrame) -> DataFrame:
    """The scope goes into the model's name."""
    return scores.withColumn("model", F.when(F.col("scope") == "target", F.concat("model", F.lit("@target"))).otherwise(F.col("model"))).drop("scope")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
