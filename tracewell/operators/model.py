"""Learned scores of candidate methods, and a cosine baseline."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SCORES = ["bfr", "bff", "cfs"]


def fit_scorer(rows: DataFrame, scores: list[str] = SCORES, hidden: int = 0, iterations: int = 20, seed: int = 7, weight: str | None = None) -> PipelineModel:
    """A scorer of rows (scores..., label): logistic regression, or with ``hidden`` units a network with one hidden layer.

    Fitted on all rows. A row counts ``weight`` times (a column of whole numbers): the regression weighs it, the network, which has no weights, gets
    it so often.
    """
    if weight and hidden:
        rows, weight = rows.where(F.col(weight) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int")))), None
    assemble = VectorAssembler(inputCols=scores, outputCol="_features", handleInvalid="skip")
    learn = (
        MultilayerPerceptronClassifier(layers=[len(scores), hidden, 2], featuresCol="_features", labelCol="label", maxIter=iterations, seed=seed)
        if hidden
        else LogisticRegression(featuresCol="_features", labelCol="label", maxIter=iterations, **({"weightCol": weight} if weight else {}))
    )
    return Pipeline(stages=[assemble, learn]).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``buggy_rate``, the probability of label 1."""
    out = model.transform(rows).withColumn("buggy_rate", vector_to_array("probability")[1])
    return out.select(*rows.columns, "buggy_rate")


def word_vectors(texts: DataFrame, size: int = 128, vocabulary: int = 5000, max_rows: int = 200_000, seed: int = 7) -> DataFrame:
    """(id, vector) of (id, terms): the mean of the skip-gram vectors of a text's terms, zeros without any known one.

    The vectors are fitted on a sample of at most about ``max_rows`` texts, cut down to the ``vocabulary`` most frequent terms of the sample (equals by
    code point); all texts get a vector.
    """
    n = texts.count()
    sample = materialize((texts.sample(max_rows / n, seed) if n > max_rows else texts).select("id", "terms"), "sample")
    words = sample.select("id", F.posexplode("terms").alias("pos", "t"))
    top = words.groupBy("t").count().orderBy(F.col("count").desc(), "t").limit(vocabulary).select("t")
    kept = words.join(F.broadcast(top), "t").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("terms"))
    if kept.isEmpty():
        return texts.select("id", F.array_repeat(F.lit(0.0), size).alias("vector"))
    model = Word2Vec(vectorSize=size, minCount=1, inputCol="terms", outputCol="_v", seed=seed, maxIter=1).fit(kept)
    known = texts.select("id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    return model.transform(known).select("id", vector_to_array("_v").alias("vector"))


def cosine(a: str, b: str):
    """Cosine of two array columns; 0 if one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0)), F.lit(0.0))
