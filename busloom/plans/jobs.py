"""The job loop: every target, feature set, protocol and fold with its detectors, from training windows to result rows; and the controls."""

from __future__ import annotations

import hashlib
import time
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.operators import evaluation, learners, nets, profile, rules, splits, windows
from busloom.operators.windows import FS_A_RAW, FS_B, FS_B34
from busloom.plans.bus import Bus, union_all
from busloom.sources import sinks

#: Training windows of a job, at most; of a subset of sources in the second control: fixed values of the protocol.
CAP_TRAIN, SOURCE_BUDGET, MAX_SUBSETS = 150_000, 40_000, 5
JOB = ["protocol", "fold", "target", "feature_set", "model"]
KEY = ["capture", "widx"]


def names(feature_set: str, vocabulary: int) -> list[str]:
    return {"FS-B": FS_B, "FS-B34": FS_B34}.get(feature_set) or [*FS_A_RAW, *[f"h_{i:02d}" for i in range(vocabulary + 1)]]


def table(b: Bus, feature_set: str, target: str, cross: bool, sources: tuple[str, ...] | None = None, sequences: bool = False) -> DataFrame:
    """WINDOW, y, q and the features, as a job of the target sees them: across vehicles the identifier-coupled set has the
    vocabulary of the other vehicles, or of sources, some of them; FS-A-rank, and jobs within a vehicle, have each vehicle's
    own. With sequences, also seq, the features of the windows up to each."""
    features = names(feature_set, b.s.vocabulary)
    if feature_set.startswith("FS-B"):
        rows = b.split
    elif feature_set == "FS-A" and cross and sources:
        rows = coded(b, sources).where(F.col("vehicle").isin(target, *sources))
    elif feature_set == "FS-A" and cross:
        rows = b.fs_a.where(F.col("target") == target).drop("target")
    else:
        rows = b.fs_a_rank
    rows = rows.select(*windows.WINDOW, "y", "q", *features)
    return nets.sequences(rows, features) if sequences else rows


def coded(b: Bus, sources: tuple[str, ...]) -> DataFrame:
    """The identifier-coupled table in the vocabulary that these vehicles have in common. Written once a set of sources."""
    places = profile.vocabulary_of(b.frames, sources, b.s.vocabulary).withColumn("target", F.lit("|".join(sources)))
    return b.kept(f"fs_a:{'|'.join(sources)}", lambda: written(b, windows.features_a(b.raw, b.messages, places, b.s).drop("target").join(b.labelled, windows.WINDOW)))


def written(b: Bus, rows: DataFrame) -> DataFrame:
    """A job's training windows, written once, as a learner reads them in every round."""
    path = sinks.scratch(b.spark, "train")
    rows.write.parquet(path)
    return b.spark.read.schema(rows.schema).parquet(path)


def capped(rows: DataFrame, cap: int, seed: str) -> DataFrame:
    return splits.capped(rows.withColumn("_g", F.lit(1)), ["_g"], KEY, cap, seed).drop("_g")


def matched(rows: DataFrame, total: int, positives: int, seed: str) -> DataFrame:
    return splits.matched(rows.withColumn("_g", F.lit(1)), ["_g"], KEY, total, positives, seed).drop("_g")


def split(b: Bus, protocol: str, fold: int, target: str, feature_set: str, sequences: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, calibration and evaluation windows of a job."""
    rows = table(b, feature_set, target, protocol == "cross", sequences=sequences)
    seed = "|".join((protocol, str(fold), target, feature_set if feature_set in ("FS-A", "FS-B") else "FS-B"))  # sets in comparison share windows
    if protocol == "cross":
        own = splits.cross(rows.where(F.col("vehicle") == target))
        train = rows.where(F.col("vehicle") != target)
    else:
        own = splits.in_domain(rows.where(F.col("vehicle") == target), fold)
        train = own.where("is_train")
    train = capped(train.select(*windows.WINDOW, "y", "q", *names(feature_set, b.s.vocabulary), *["seq"] * sequences), CAP_TRAIN, seed)
    return written(b, train), own.where("is_calib"), own.where("is_eval")


def fit_and_score(kind: str, train: DataFrame, parts: dict[str, DataFrame], features: list[str], effort: learners.Effort = learners.FULL) -> DataFrame:
    """Long scores of the parts (name -> rows): side, WINDOW, y, model, score.

    kind: a family, an ensemble, IForest or a rule. A name with @target is fitted on the calibration windows, the part "cal".
    """
    base, at_target, _ = kind.partition("@")
    fitted_on = parts["cal"] if at_target else train.where("y = 0")
    if base == "IForest":
        model = learners.IsolationForest(features, effort=effort).fit(fitted_on, KEY)
        scored = {side: model.score(rows) for side, rows in parts.items()}
    elif base.startswith("Rule:"):
        return rule_scored([kind], fitted_on, parts, features)
    elif base == "Ens:Stack-Trees":
        model = learners.Stacked(learners.ENSEMBLES[base], features, effort).fit(train, KEY)
        scored = {side: model.score(rows) for side, rows in parts.items()}
    elif base in learners.ENSEMBLES:
        model = learners.RankAveraged(learners.ENSEMBLES[base], features, effort).fit(train, KEY)
        scored = {side: model.score(rows, [*windows.WINDOW, "y"]) for side, rows in parts.items()}
    else:
        model = learners.learner(kind, features, effort=effort).fit(train, KEY)
        scored = {side: model.score(rows) for side, rows in parts.items()}
    return union_all([rows.select(F.lit(side).alias("side"), *windows.WINDOW, "y", F.lit(kind).alias("model"), "score") for side, rows in scored.items()])


def rule_scored(kinds: list[str], fitted_on: DataFrame, parts: dict[str, DataFrame], features: list[str]) -> DataFrame:
    """Long scores of rules of one scope, whose reference is fitted on attack-free windows once; the panel is that of the feature set."""
    high, two_sided = (rules.HIGH, rules.TWO_SIDED) if "stale_max" in features else (rules.HIGH34, rules.TWO_SIDED34)
    panel, keys, group = [*high, *two_sided], ["side", *windows.WINDOW, "y"], ["scope"]
    names_of = {k.partition("@")[0]: k for k in kinds}
    if unknown := set(names_of) - {*rules.SINGLE, "Rule:UnseenID", "Rule:Combined", "Rule:CombinedQ"}:
        raise ValueError(f"no rule is called {sorted(unknown)}")
    rows = union_all([r.select(*windows.WINDOW, "y", *panel).withColumn("side", F.lit(side)) for side, r in parts.items()])
    fit = rules.melted(fitted_on.select(*panel), [], panel).withColumn("scope", F.lit("job"))
    long = rules.melted(rows, keys, panel).withColumn("scope", F.lit("job"))
    fitted = rules.reference(fit, group)
    z, out = rules.z_scores(long, fitted, group), []
    if set(names_of) != {"Rule:CombinedQ"}:
        out.append(rules.rule_scores(z, keys, high, two_sided).where(F.col("model").isin(*names_of)))
    if "Rule:CombinedQ" in names_of:
        both = z.withColumn("is_ref", F.lit(False)).unionByName(rules.z_scores(fit, fitted, group).withColumn("is_ref", F.lit(True)), allowMissingColumns=True)
        out.append(rules.quantile_scores(both, keys, group, high, two_sided).withColumn("model", F.lit("Rule:CombinedQ")))
    suffix = next(iter(kinds)).partition("@")[1:]
    return union_all(out).withColumn("model", F.concat("model", F.lit("".join(suffix)))).select(*keys, "model", "score")


def batches(kinds: list[str]) -> list[list[str]]:
    """Detectors that are fitted together: the rules of one scope; every other one by itself."""
    groups: dict[str, list[str]] = {}
    for k in kinds:
        groups.setdefault("@target" * k.endswith("@target") if k.startswith("Rule:") else k, []).append(k)
    return list(groups.values())


def specs(b: Bus, feature_sets: list[str]) -> DataFrame:
    """A row for each job: across vehicles once, within a vehicle in two folds."""
    kinds = b.spark.createDataFrame([("cross", 0), ("in", 0), ("in", 1)], "protocol string, fold int")
    sets = b.spark.createDataFrame([(f,) for f in feature_sets], "feature_set string")
    return kinds.crossJoin(b.vehicles.select(F.col("vehicle").alias("target"))).crossJoin(sets)  # a few rows each


SPEC = ["protocol", "fold", "target", "feature_set"]
_DONE = "protocol string, fold int, target string, feature_set string, model string, part int, n_train long, n_train_pos long, seconds double, error string"


def finished(b: Bus, store: str) -> DataFrame:
    """(SPEC, model, part, n_train, n_train_pos, seconds, error): what the store says is done: a row for each job and detector.

    error is null where it was scored; seconds are those of fitting, scoring and writing, shared by rules of one scope.
    """
    from pyspark.errors import AnalysisException

    try:
        return b.spark.read.schema(_DONE).option("recursiveFileLookup", "true").parquet(f"{store}/finished")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return b.spark.createDataFrame([], _DONE)


def run(b: Bus, feature_sets: list[str], kinds, store: str, effort: learners.Effort = learners.FULL, threads: int = 8) -> tuple[DataFrame, DataFrame]:
    """Runs the jobs that the store hasn't got and returns (scores, finished) of all its jobs.

    kinds: detectors, or a function of (feature set, protocol) that names them. A job writes its scores detector by detector
    and, after them, a marker into the store; one that is broken off has none, so the next run does it again and overwrites what
    it left. A detector that fails leaves its error in the marker and no score; it neither ends its job nor others. Beside the
    marker a job writes a text log (log_lines).
    """
    todo = sinks.pending(specs(b, feature_sets), finished(b, store), SPEC)
    of = kinds if callable(kinds) else lambda *_: list(kinds)

    def job(spec) -> None:
        wanted = of(spec["feature_set"], spec["protocol"])
        train, calib, evaluated = split(b, *(spec[k] for k in SPEC), sequences=any(k in learners.SEQUENCE for k in wanted))
        features, done, todo = names(spec["feature_set"], b.s.vocabulary), [], batches(wanted)
        n, positive = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
        for part, batch in enumerate(todo):
            parts, error, began = {"cal": calib, "ev": evaluated}, None, time.time()
            try:
                if len(batch) > 1:
                    rows = rule_scored(batch, calib if batch[0].endswith("@target") else train.where("y = 0"), parts, features)
                else:
                    rows = fit_and_score(batch[0], train, parts, features, effort)
                rows.write.mode("overwrite").parquet(_part(store, spec, part))
            except Exception as e:  # a detector's failure is a result
                error = f"{type(e).__name__}: {e}"[:500]
                if len(batch) > 1:
                    todo += [[k] for k in batch]  # which of them it is, each shows by itself
                    continue
            done += [(*(spec[k] for k in SPEC), kind, part, n, positive, round(time.time() - began, 2), error) for kind in batch]
        rows, name = b.spark.createDataFrame(done, _DONE).coalesce(1), "-".join(str(spec[k]) for k in SPEC)
        log_lines(rows).write.mode("overwrite").text(f"{store}/logs/{name}")
        rows.write.mode("overwrite").parquet(f"{store}/finished/{name}")

    learners.side_by_side([lambda s=s: job(s) for s in todo.collect()], threads)  # a row a job
    done = finished(b, store)
    kept = done.where("error IS NULL").select(*SPEC, "part").distinct().collect()  # a row a job and batch of detectors
    parts = [stated(b.spark.read.schema(_SCORES).parquet(_part(store, r, r["part"])), **{k: r[k] for k in SPEC}) for r in kept]
    return union_all(parts) if parts else b.spark.createDataFrame([], ", ".join(f"{k} {'int' if k == 'fold' else 'string'}" for k in SPEC) + ", " + _SCORES), done


def log_lines(done: DataFrame) -> DataFrame:
    """(value): a line of text for each detector of a job: its windows, seconds, and scored or why not."""
    where = F.concat_ws("_", "protocol", F.concat(F.lit("f"), "fold"), "target", "feature_set")
    return done.select(F.concat(F.lit("["), where, F.lit("] "), "model", F.format_string(" train=%d (pos %d) %.2f s ", "n_train", "n_train_pos", "seconds"), F.coalesce(F.concat(F.lit("!! "), "error"), F.lit("scored"))).alias("value"))


def _part(store: str, spec, part: int) -> str:
    return f"{store}/scores/" + "/".join(f"{k}={spec[k]}" for k in SPEC) + f"/part={part}"


_SCORES = "side string, vehicle string, capture string, family string, widx long, y int, model string, score double"


def results(b: Bus, scores: DataFrame, job: list[str] = JOB) -> DataFrame:
    """Counts, recalls and rates at every operating point, event recall and both areas, of all jobs in one plan."""
    calib, ev = scores.where("side = 'cal'"), scores.where("side = 'ev'")
    sizes = calib.groupBy(*job).agg(F.count(F.lit(1)).alias("n_calib")).join(b.seconds.select(F.col("vehicle").alias("target"), "win_seconds"), "target")
    limits = evaluation.thresholds(calib, evaluation.operating_points(sizes), job)
    predicted = evaluation.alarms(ev, limits, job)
    counts = evaluation.confusion(predicted, job)
    events = evaluation.event_recall(predicted, job).where("family = 'all'").select(*job, "tag", "event_recall")
    return counts.join(events, [*job, "tag"], "left").join(evaluation.ranking(ev, job).select(*job, "roc_auc", "pr_auc"), job)


#: Detectors of the controls: the quick families, and rules where the set has their features.
QUICK_KINDS = ("LogReg", "RandomForest", "HistGB", "XGBoost", "LightGBM")
CONTROL_RULES = {"FS-B": ("Rule:Combined", "Rule:Staleness"), "FS-B34": ("Rule:Combined",)}


def control_kinds(feature_set: str, only: tuple[str, ...] | None = None) -> list[str]:
    return [k for k in (*QUICK_KINDS, *CONTROL_RULES.get(feature_set, ())) if only is None or k in only]


def volume_control(b: Bus, kinds: tuple[str, ...] | None = None, feature_sets=("FS-A", "FS-B"), seeds=(0, 1, 2), effort: learners.Effort = learners.FULL) -> DataFrame:
    """Trained across vehicles on as many windows, attacked ones among them, as the job within the vehicle has; evaluated on both jobs' windows."""

    def one(target: str, fs: str, seed: int) -> DataFrame:
        inner, c0, e0 = split(b, "in", 0, target, fs)
        n, pos = inner.agg(F.count(F.lit(1)), F.sum("y")).first()
        rows = table(b, fs, target, True)
        _, c1, e1 = split(b, "cross", 0, target, fs)
        own = rows.where(F.col("vehicle") == target)  # both sets of windows in the job's own coding
        inside = lambda w: own.join(w.select(*windows.WINDOW), windows.WINDOW, "left_semi")
        train = written(b, matched(rows.where(F.col("vehicle") != target), n, pos or 0, f"A|{target}|{fs}|{seed}"))
        parts = {"cal:cross": c1, "ev:cross": e1, "cal:in_f0": inside(c0), "ev:in_f0": inside(e0)}
        scored = union_all([fit_and_score(k, train, parts, names(fs, b.s.vocabulary), effort) for k in control_kinds(fs, kinds)])
        side = F.split("side", ":")
        return stated(scored.withColumn("eval_set", side[1]).withColumn("side", side[0]), target=target, feature_set=fs, seed=seed)

    jobs = [(t, fs, s) for t in _targets(b) for fs in feature_sets for s in seeds]
    return results(b, _stored(b, one, jobs), ["target", "feature_set", "seed", "eval_set", "model"])


def source_control(b: Bus, kinds: tuple[str, ...] | None = ("XGBoost", "HistGB", "Rule:Combined"), feature_sets=("FS-B", "FS-A"), seeds=(0, 1), budget: int = SOURCE_BUDGET, effort: learners.Effort = learners.FULL) -> DataFrame:
    """Trained on every combination of k other vehicles (MAX_SUBSETS of them at most, the first by a hash), at one volume.

    The identifier-coupled set has the vocabulary of the combination's vehicles alone, for the target's windows too.
    """

    def one(target: str, fs: str, some: tuple[str, ...], seed: int) -> DataFrame:
        rows = table(b, fs, target, True, some)
        own = splits.cross(rows.where(F.col("vehicle") == target))
        train = written(b, matched(rows.where(F.col("vehicle").isin(*some)), budget, budget // 2, f"B|{target}|{fs}|{'|'.join(some)}|{seed}"))
        scored = union_all([fit_and_score(k, train, {"cal": own.where("is_calib"), "ev": own.where("is_eval")}, names(fs, b.s.vocabulary), effort) for k in control_kinds(fs, kinds)])
        return stated(scored, target=target, feature_set=fs, seed=seed, n_sources=len(some), sources="|".join(some))

    jobs = []
    for t in _targets(b):
        others = [v for v in _targets(b) if v != t]
        for k in range(1, len(others) + 1):
            subsets = sorted(combinations(others, k), key=lambda c: hashlib.md5("|".join((t, *c)).encode()).hexdigest())[:MAX_SUBSETS]
            jobs += [(t, fs, c, s) for fs in feature_sets for c in sorted(subsets) for s in seeds]
    return results(b, _stored(b, one, jobs), ["target", "feature_set", "seed", "n_sources", "sources", "model"])


def feature_control(b: Bus, kinds: tuple[str, ...] | None = None, feature_sets=("FS-B34", "FS-B", "FS-A-rank", "FS-A"), effort: learners.Effort = learners.FULL) -> DataFrame:
    """The same windows in four feature sets, trained across vehicles."""

    def one(target: str, fs: str) -> DataFrame:
        train, calib, evaluated = split(b, "cross", 0, target, fs)
        scored = union_all([fit_and_score(k, train, {"cal": calib, "ev": evaluated}, names(fs, b.s.vocabulary), effort) for k in control_kinds(fs, kinds)])
        return stated(scored, target=target, feature_set=fs)

    jobs = [(t, fs) for t in _targets(b) for fs in feature_sets]
    return results(b, _stored(b, one, jobs), ["target", "feature_set", "model"])


def stated(scored: DataFrame, **columns) -> DataFrame:
    return scored.select(*[F.lit(v).alias(c) for c, v in columns.items()], "*")


def _stored(b: Bus, one, jobs: list[tuple]) -> DataFrame:
    """The scores of jobs that run side by side, each written as soon as it is done."""
    return union_all(learners.side_by_side([lambda j=j: written(b, one(*j)) for j in jobs]))


def _targets(b: Bus) -> list[str]:
    return sorted(r["vehicle"] for r in b.vehicles.select("vehicle").collect())  # a row a vehicle
