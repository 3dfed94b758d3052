"""Learners per head, calibrators and scoring with Spark ML."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake import constants as K
from tremorlake.functions.heads import HEADS, head_columns
from tremorlake.operators import boosting
from tremorlake.operators.ensemble import calibrated, logit
from tremorlake.operators.features import feature_columns
from tremorlake.operators.labels import folds, time_split
from tremorlake.operators.priors import clip
from tremorlake.session import scratch_path


_CALIBRATOR = "kind string, a double, b double, c double, xs array<double>, ys array<double>, trained boolean, metrics string, features array<string>"


@dataclass
class HeadModel:
    """Two learners, the chosen calibrator row and the validation Brier scores."""
    boosted: PipelineModel | None
    forest: PipelineModel | None
    calibrator: dict
    metrics: dict
    features: list[str]


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing and NaN features become zero."""
    return df.withColumns({c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})


def fit_learners(train: DataFrame, label: str, features: list[str], rounds: int = 200,
                 trees: int = 200) -> tuple[PipelineModel | None, PipelineModel | None]:
    """Boosted trees and a forest, positives weighted by neg/pos; none for one class."""
    pos, n = train.agg(F.sum(label), F.count("*")).first()
    pos, n = int(pos or 0), int(n or 0)
    if pos == 0 or pos == n:
        return None, None
    data = prepared(train, features).withColumns({
        "label": F.col(label).cast("double"), "w": F.when(F.col(label) == 1, max(n - pos, 1) / max(pos, 1)).otherwise(1.0)})
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    common = {"labelCol": "label", "featuresCol": "features", "weightCol": "w", "maxDepth": 4, "seed": 42}
    boosted = GBTClassifier(maxIter=rounds, stepSize=0.08, **common)
    forest = RandomForestClassifier(numTrees=trees, **common)
    return _stored(Pipeline(stages=[assemble, boosted]).fit(data), "boosted"), _stored(Pipeline(stages=[assemble, forest]).fit(data), "forest")


def _stored(model: PipelineModel, name: str) -> PipelineModel:
    """The model as read back from the shared folder. A freshly fitted forest keeps a summary
    that refers to the session, which cannot travel to workers; a stored one does not."""
    path = scratch_path(SparkSession.getActiveSession(), f"learner-{name}")
    model.write().save(path)
    return PipelineModel.load(path)


def probability(model: PipelineModel | None, df: DataFrame, features: list[str], name: str) -> DataFrame:
    if model is None:
        return df.withColumn(name, F.lit(0.0))
    scored = model.transform(prepared(df, features))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_calibrators(scored: DataFrame, label: str) -> tuple[dict, dict]:
    """Platt, isotonic and beta against identity; the least validation Brier wins.

    ``scored`` has column p and the label.
    """
    eps = K.PROB_FLOOR
    q = clip(F.col("p"), eps, 1 - eps)
    data = scored.select("p", F.col(label).cast("double").alias("label"), logit(F.col("p"), eps).alias("z"), F.ln(q).alias("lp"), F.ln(1 - q).alias("lq")).persist()
    try:
        classes = data.agg(F.min("label"), F.max("label")).first()
        rows = [{"kind": "identity", "a": 0.0, "b": 0.0, "c": 0.0, "xs": [0.0], "ys": [0.0]}]
        if classes[0] != classes[1]:
            lr = LogisticRegression(maxIter=50, regParam=1e-6)
            platt = lr.fit(VectorAssembler(inputCols=["z"], outputCol="features").transform(data))
            beta = lr.fit(VectorAssembler(inputCols=["lp", "lq"], outputCol="features").transform(data))
            # equal scores are pooled first, so that the fit sees distinct scores only
            pooled = data.groupBy("p").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("w"))
            iso = IsotonicRegression(featuresCol="p", weightCol="w").fit(pooled)
            rows += [{"kind": "platt", "a": float(platt.coefficients[0]), "b": 0.0, "c": float(platt.intercept), "xs": [0.0], "ys": [0.0]},
                     {"kind": "beta", "a": float(beta.coefficients[0]), "b": float(beta.coefficients[1]), "c": float(beta.intercept), "xs": [0.0], "ys": [0.0]},
                     {"kind": "isotonic", "a": 0.0, "b": 0.0, "c": 0.0, "xs": [float(v) for v in iso.boundaries], "ys": [float(v) for v in iso.predictions]}]
        table = data.sparkSession.createDataFrame([(r["kind"], r["a"], r["b"], r["c"], r["xs"], r["ys"]) for r in rows],
                                                  "kind string, a double, b double, c double, xs array<double>, ys array<double>")
        listed = table.agg(F.collect_list(F.struct("*")).alias("options"))  # four rows
        briers = data.select("p", "label").withColumn("k", F.lit(1)).join(F.broadcast(listed.withColumn("k", F.lit(1))), "k").select(
            "p", "label", F.inline("options")).withColumn("q", F.when(F.col("kind") == "identity", F.col("p")).otherwise(calibrated(F.col("p")))).groupBy(
            "kind").agg(F.avg(F.pow(F.col("q") - F.col("label"), 2)).alias("brier"))
        metrics = {r["kind"]: r["brier"] for r in briers.collect()}  # at most four rows
    finally:
        data.unpersist()
    best = min(metrics, key=lambda k: (metrics[k], k))
    return next(r for r in rows if r["kind"] == best), metrics


def save_head(model: HeadModel, path: str) -> None:
    """Store a head: both pipelines, and its calibrator as a one-row table."""
    for name in ("boosted", "forest"):
        if getattr(model, name) is not None:
            getattr(model, name).write().overwrite().save(f"{path}/{name}")
    c = model.calibrator
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(c["kind"], c["a"], c["b"], c["c"], c["xs"], c["ys"], model.boosted is not None, json.dumps(model.metrics), model.features)], _CALIBRATOR) \
        .write.mode("overwrite").parquet(f"{path}/calibrator")


def load_head(spark: SparkSession, path: str) -> HeadModel:
    row = spark.read.schema(_CALIBRATOR).parquet(f"{path}/calibrator").first()
    pipes = [PipelineModel.load(f"{path}/{name}") if row["trained"] else None for name in ("boosted", "forest")]
    return HeadModel(*pipes, {k: row[k] for k in ("kind", "a", "b", "c", "xs", "ys")}, json.loads(row["metrics"]), list(row["features"]))


def active_path(registry: DataFrame, root: str, head: str) -> str:
    """Folder of a head of the active version; a registry without one has none."""
    row = registry.where("is_active").orderBy("version").first()
    if row is None:
        raise ValueError("no version is active")
    return f"{root}/{row['version']}/{head}"


def score(model: HeadModel, df: DataFrame) -> DataFrame:
    """Both learners' probabilities, with the columns the model was trained on."""
    return probability(model.forest, probability(model.boosted, df, model.features, "p1"), model.features, "p2")


def train_and_score_heads(dataset: DataFrame, rounds: int = 200) -> DataFrame:
    """Both boosted learners of every head on the purged split, calibrated, scoring the later snapshots.

    The calibrator of a head is chosen on validation rows, or, where those hold one class only, on rows
    of three held-out folds of the training rows. It sees the mean of the two learners. A head
    whose training rows hold one class has scores of zero and no calibrator.
    """
    spark = dataset.sparkSession
    labels, features, identity = head_columns(), feature_columns(), {"kind": "identity", "a": 0.0, "b": 0.0, "c": 0.0, "xs": [0.0], "ys": [0.0]}

    def held(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    split = time_split(held(prepared(dataset, features), "dataset"))
    train, val, test = (split.where(F.col("split") == s) for s in ("train", "val", "test"))
    heads, none = list(range(len(labels))), F.lit(boosting.FULL)
    spread = val.agg(*[(F.min(c) < F.max(c)).alias(c) for c in labels]).first()
    crossed = [h for h in heads if not spread[h]]
    edges = boosting.bin_edges(train, features)
    wanted = [(h, n, f) for h in heads for n in range(len(boosting.LEARNERS)) for f in ([boosting.FULL, 0, 1, 2] if h in crossed else [boosting.FULL])]
    parts = folds(train, ["cell_no", "k"]) if crossed else train.withColumn("fold", F.lit(0))
    models = boosting.fit_models(parts, features, labels, edges, wanted, F.col("fold"), rounds)
    full = [h for h in heads if (h, 0, boosting.FULL) in models]
    mean = ((F.col("p1") + F.col("p2")) / 2).alias("p")
    checked = [x for x in ([h for h in full if h not in crossed], [h for h in full if h in crossed])]
    held_out = [boosting.score_rows(df, features, labels, edges, models, fold, [], hs).select("head", "y", mean)
                for df, fold, hs in ((val, none, checked[0]), (parts, F.col("fold"), checked[1])) if hs]
    calibrators = {}
    if held_out:
        scored = held(held_out[0] if len(held_out) == 1 else held_out[0].unionByName(held_out[1]), "held-out")
        with ThreadPoolExecutor(4) as pool:  # jobs of several heads share the cluster
            calibrators = dict(zip(full, pool.map(lambda h: fit_calibrators(scored.where(F.col("head") == h), "y"), full)))
    rows = []
    for h, (horizon, threshold) in enumerate(HEADS):
        c, metrics = calibrators.get(h, (identity, {}))
        rows.append((h, horizon, float(threshold), c["kind"], c["a"], c["b"], c["c"], c["xs"], c["ys"], metrics.get(c["kind"]), metrics.get("identity")))
    table = spark.createDataFrame(rows, "head int, horizon_days int, mag_threshold double, kind string, a double, b double, c double, xs array<double>, ys array<double>, "
                                        "brier double, brier_identity double")
    out = boosting.score_rows(test, features, labels, edges, models, none, ["cell_id", "k"], heads).withColumn("p", mean)
    return out.join(F.broadcast(table), "head").select("cell_id", "k", "horizon_days", "mag_threshold", "y", "p1", "p2", calibrated(F.col("p")).alias("p"), "kind",
                                                       "brier", "brier_identity")
