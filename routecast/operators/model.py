"""A success model on question text."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(train: DataFrame, features: int = 1 << 12, penalty: float = 1e-3) -> PipelineModel:
    """Logistic regression on hashed words; an item weighs c as a success and k - c as a failure."""
    d = train.where("text is not null")
    two = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("correct_count").cast("double").alias("weight")),
                            F.struct(F.lit(0.0).alias("label"), (F.col("k") - F.col("correct_count")).cast("double").alias("weight")))).alias("x")
    rows = d.select("text", two).select("text", "x.*").where("weight > 0")
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True),
              LogisticRegression(weightCol="weight", regParam=penalty, maxIter=50)]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds `probability` to rows with `text`; a null text counts as empty."""
    keep = df.columns
    out = model.transform(df.withColumn("text", F.coalesce("text", F.lit(""))))
    return out.select(*keep, vector_to_array("probability")[1].alias("probability"))
