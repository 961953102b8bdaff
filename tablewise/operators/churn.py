"""Churn model: boosted trees over customer behaviour."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions import rules
from tablewise.functions.columns import real
from tablewise.operators.quantiles import exact_quantiles

LABEL = "churn_label"
OPTIONAL = ("avg_review_score",)
FACTS = "features array<string>, auc double, weight double"


@dataclass(frozen=True)
class ChurnModel:
    model: PipelineModel
    features: tuple[str, ...]
    holdout_auc: float | None
    positive_weight: float

    def save(self, path: str) -> None:
        """The pipeline, and beside it the features and figures it was trained with."""
        self.model.write().overwrite().save(f"{path}/pipeline")
        facts = [(list(self.features), self.holdout_auc, float(self.positive_weight))]
        spark = SparkSession.active()
        spark.createDataFrame(facts, FACTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load_churn(path: str) -> ChurnModel:
    """A stored model, ready to score new customers."""
    facts = SparkSession.active().read.parquet(f"{path}/facts").first()
    return ChurnModel(PipelineModel.load(f"{path}/pipeline"), tuple(facts["features"]), facts["auc"], facts["weight"])


def churn_features(summary: DataFrame) -> DataFrame:
    """Features and label from the customer summary; no view yields a review score."""
    return summary.select(
        "customer_unique_id",
        *(F.col(c).cast("double").alias(c) for c in rules.CHURN_FEATURES if c not in OPTIONAL),
        F.lit(None).cast("double").alias("avg_review_score"),
        F.col(LABEL).cast("double").alias(LABEL),
    )


def _check(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns) - set(OPTIONAL))
    if missing:
        raise ValueError(f"churn needs the columns {', '.join(missing)}")


def _filled(df: DataFrame, features) -> tuple[DataFrame, tuple[str, ...]]:
    """Missing features become the column median; a feature without any value is left out."""
    present = [c for c in features if c in df.columns]
    numbers = {c: real(F.col(c), df.schema[c].dataType) for c in present}
    medians = {c: q.values[0] for c, q in exact_quantiles(df, numbers, (0.5,)).items() if q.count}
    return df.withColumns({c: F.coalesce(numbers[c], F.lit(m)) for c, m in medians.items()}), tuple(medians)


def _draw(*columns: str, seed: int):
    """A repeatable number in [0, 1) per row, from the row itself."""
    return (F.xxhash64(F.lit(seed), *columns).cast("double") / F.lit(2.0**64)) + 0.5


def stratified_split(df: DataFrame, label: str, share: float, *identity: str, seed: int = 42):
    """Exact share of every class, repeatable: rows are split at the class's quantile of a
    hash, so no class is ranked in one task."""
    drawn = df.withColumn("__draw", _draw(*identity, seed=seed))
    classes = [r[0] for r in drawn.select(label).distinct().orderBy(label).collect()]
    cuts = exact_quantiles(
        drawn, {str(c): F.when(F.col(label) == c, F.col("__draw")) for c in classes}, (share,)
    )
    below = F.lit(False)
    for c in classes:
        below = below | ((F.col(label) == c) & (F.col("__draw") <= cuts[str(c)].values[0]))
    return drawn.filter(below).drop("__draw"), drawn.filter(~below).drop("__draw")


def train_churn(
    df: DataFrame, iterations: int = 200, depth: int = 5, rate: float = 0.1, seed: int = 42
) -> ChurnModel:
    _check(df, (*rules.CHURN_FEATURES, LABEL))
    labelled = df.withColumn(LABEL, F.col(LABEL).cast("double"))
    counts = {r[LABEL]: r["n"] for r in labelled.groupBy(LABEL).agg(F.count("*").alias("n")).limit(4).collect()}
    if set(counts) != {0.0, 1.0}:
        raise ValueError("churn_label needs both of its classes")
    filled, features = _filled(labelled, rules.CHURN_FEATURES)
    train, holdout = stratified_split(filled, LABEL, 0.8, *features, LABEL, seed=seed)
    in_train = {r[LABEL]: r["n"] for r in train.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}
    weight = in_train[0.0] / in_train[1.0]
    weighted = train.withColumn("weight", F.when(F.col(LABEL) == 1, F.lit(weight)).otherwise(1.0))
    trees = GBTClassifier(
        labelCol=LABEL, featuresCol="features", weightCol="weight", maxIter=iterations, maxDepth=depth,
        stepSize=rate, seed=seed,
    )
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    model = Pipeline(stages=[assemble, trees]).fit(weighted)
    scored = model.transform(holdout)
    both = scored.select(LABEL).distinct().count() == 2
    auc = BinaryClassificationEvaluator(labelCol=LABEL).evaluate(scored) if both else None
    return ChurnModel(model, features, auc, weight)


def score_churn(df: DataFrame, trained: ChurnModel) -> DataFrame:
    _check(df, rules.CHURN_FEATURES)
    kept = {c: f"__{c}" for c in trained.features if c in df.columns}  # the inputs come back as they are
    filled, known = _filled(df.withColumns({new: F.col(c) for c, new in kept.items()}), trained.features)
    filled = filled.withColumns({c: F.lit(0.0) for c in trained.features if c not in known})
    scored = trained.model.transform(filled)
    probability = vector_to_array("probability")[1]
    return scored.withColumn("churn_probability", probability).select(
        *(F.col(kept.get(c, c)).alias(c) for c in df.columns), "churn_probability", (F.col("churn_probability") >= 0.5).cast("int").alias("churn_prediction")
    )
