"""The classifier of future directions: features, split, calibrated regression, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

RULES = ["hook_cnt", "modal_cnt", "will_inf"]


def with_features(df: DataFrame, sentence: str = "sentence", embedding: str | None = None) -> DataFrame:
    """``df`` with the vector ``features``: the embedding, if there is one, and the three counts of rules."""
    from pyspark.ml.functions import array_to_vector

    f = X.rule_features(F.col(sentence))
    rules = F.array(*[f[r].cast("double") for r in RULES])
    return df.withColumn("features", array_to_vector(F.concat(F.col(embedding), rules) if embedding else rules))


def stratified_split(df: DataFrame, share: float = 0.2, seed: int = 42, key: str = "doc_id", label: str = "label") -> DataFrame:
    """``df`` with ``is_test``: of each label the rows of the least hashes, the share rounded to whole rows.

    Rows are numbered within 4096 ranges of hashes for each label, and the ranges' counts say
    how many come before, so no label is one task.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))
    placed = df.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 3))
    per = placed.groupBy(F.col(label).alias("_label"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_label").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).withColumn("_most", F.floor(F.sum("_n").over(Window.partitionBy("_label")) * share + 0.5))
    nth = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", key))
    placed = placed.withColumn("_nth", nth).join(per, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range").eqNullSafe(F.col("_of"))))
    return placed.withColumn("is_test", F.col("_before") + F.col("_nth") <= F.col("_most")).select(*df.columns, "is_test")


def report(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score") -> DataFrame:
    """Counts, precision, recall, F1, accuracy and the AUC by ranks, in one row.

    Ranks come from the counts of distinct scores, so what is sorted is no longer than those.
    """
    y, p = F.col(label) == 1, F.col(prediction) == 1
    n = lambda c: F.count_if(c)
    counts = df.agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))
    per = df.groupBy(F.col(score).alias("s")).agg(n(y).alias("pos"), n(~y).alias("neg"))
    # 64 ranges of scores are sorted apart, then shifted by what lies below them
    parts = per.repartitionByRange(64, "s").withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("below", F.coalesce(F.sum("neg").over(within), F.lit(0)))
    sums = parts.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("won"))
    shift = F.coalesce(F.sum("neg").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 64 rows
    auc = sums.withColumn("shift", shift).agg((F.sum(F.col("won") + F.col("pos") * F.col("shift")) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    r = lambda c: F.round(c, 6)
    c = F.col
    return counts.crossJoin(F.broadcast(auc)).select(  # one row each
        "tp", "fp", "fn", "tn", r(c("tp") / (c("tp") + c("fp"))).alias("precision"), r(c("tp") / (c("tp") + c("fn"))).alias("recall"), r(2 * c("tp") / (2 * c("tp") + c("fp") + c("fn"))).alias("f1"), r((c("tp") + c("tn")) / (c("tp") + c("fp") + c("fn") + c("tn"))).alias("accuracy"), r("auc").alias("auc"),
    )


class CalibratedClassifier:
    """Three folds of balanced logistic regression, each with a sigmoid fitted on the fold left out; their mean."""

    def __init__(self, models: list[tuple[object, object]]):
        self.models = models

    @classmethod
    def fit(cls, df: DataFrame, folds: int = 3, key: str = "sentence", label: str = "label") -> CalibratedClassifier:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector, vector_to_array

        n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
        total, weight = sum(n.values()), F.lit(0.0)
        for value, count in n.items():
            weight = F.when(F.col(label) == value, total / (len(n) * count)).otherwise(weight)
        df = df.withColumn("weight", weight).withColumn("fold", F.pmod(F.xxhash64(F.lit(42), key), F.lit(folds)))
        models = []
        for k in range(folds):
            train = df.where(F.col("fold") != k)
            base = LogisticRegression(labelCol=label, weightCol="weight", maxIter=1000, regParam=1 / max(1, total), standardization=False).fit(train)
            held = base.transform(df.where(F.col("fold") == k)).withColumn("raw", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))
            models.append((base, LogisticRegression(labelCol=label, featuresCol="raw", maxIter=100, rawPredictionCol="r2", probabilityCol="p2", predictionCol="c2").fit(held.drop("rawPrediction", "probability", "prediction"))))
        return cls(models)

    def score(self, features: Column) -> Column:
        """The mean probability, as one expression over the vector column: no Python, no shuffle."""
        from pyspark.ml.functions import vector_to_array

        x, out = vector_to_array(features), F.lit(0.0)
        for base, sigmoid in self.models:
            raw = F.lit(float(base.intercept)) + F.aggregate(F.zip_with(x, F.array(*[F.lit(float(c)) for c in base.coefficients]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            out = out + 1 / (1 + F.exp(-(F.lit(float(sigmoid.intercept)) + raw * float(sigmoid.coefficients[0]))))
        return out / len(self.models)

    def save(self, path: str) -> None:
        for i, pair in enumerate(self.models):
            for name, model in zip(("base", "sigmoid"), pair):
                model.write().overwrite().save(f"{path}/{name}-{i}")

    @classmethod
    def load(cls, path: str, folds: int = 3) -> CalibratedClassifier:
        from pyspark.ml.classification import LogisticRegressionModel

        return cls([tuple(LogisticRegressionModel.load(f"{path}/{name}-{i}") for name in ("base", "sigmoid")) for i in range(folds)])
