"""Linear probes on frozen vectors."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.functions import vectors as fv
from strandkit.operators.metrics import accuracy_and_macro_f1, auroc, auroc_one_vs_rest, one_row
from strandkit.operators.sampling import trainable_labels


def probe_predictions(
    df: DataFrame, vec: str, label: str, split: str = "split", least: int = 40, c: float = 1.0, max_iter: int = 200
) -> tuple[DataFrame, list[str]]:
    """(truth, predicted, scores) of the test rows, and the class list.

    Classes need ``least`` training rows.  Features are standardized with the
    population deviation of the training rows; the penalty equals 1 / (C n).
    """
    usable = trainable_labels(df.filter(F.col(split).isin("train", "test")), split, label, least).select(
        F.col(label).alias("truth"), F.col(split).alias("split"), array_to_vector(fv.doubles(F.col(vec))).alias("raw")
    ).persist()
    try:
        train = usable.filter("split = 'train'")
        n_train = train.count()
        if n_train == 0:
            raise ValueError("no class has enough training rows")
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features").fit(train)
        indexer = StringIndexer(inputCol="truth", outputCol="y", stringOrderType="frequencyDesc").fit(train)
        # The scaler divides by the sample deviation, sqrt(n / (n - 1)) too much:
        # weights grow by that factor, so the penalty shrinks by its square.
        factor = n_train / max(n_train - 1, 1)
        model = LogisticRegression(
            featuresCol="features", labelCol="y", maxIter=max_iter, elasticNetParam=0.0, standardization=False,
            regParam=1.0 / (c * n_train) / factor, tol=1e-7,
        ).fit(indexer.transform(scaler.transform(train)))
    finally:
        usable.unpersist()
    labels = list(indexer.labels)
    names = F.array(*[F.lit(x) for x in labels])
    test = scaler.transform(usable.filter("split = 'test'"))
    scored = model.transform(test).select(
        "truth",
        F.get(names, F.col("prediction").cast("int")).alias("predicted"),
        F.map_from_arrays(names, vector_to_array("probability")).alias("scores"),
    )
    return scored, labels


def run_probe(
    df: DataFrame, vec: str, label: str, split: str = "split", least: int = 40, c: float = 1.0, max_iter: int = 200
) -> DataFrame:
    """One row: n_classes, n_test, accuracy, macro_f1, auroc (binary) or its macro."""
    scored, labels = probe_predictions(df, vec, label, split, least, c, max_iter)
    basic = accuracy_and_macro_f1(scored, "truth", "predicted").withColumnRenamed("n", "n_test").withColumn(
        "n_classes", F.lit(len(labels))
    )
    if len(labels) == 2:
        flat = scored.withColumn("s", F.element_at("scores", F.lit(labels[0])))
        area = auroc(flat, F.col("truth") == labels[0], "s").select("auroc")
    else:
        area = auroc_one_vs_rest(scored, "truth", "scores").select(F.col("auroc_macro_ovr").alias("auroc"))
    return one_row(basic, area)


def metric_rows(result: DataFrame, representation: str, axis: str, task: str | Column) -> DataFrame:
    """Long form (representation, axis, task, metric, value) of a small result; a
    column as task names the rows."""
    cols = [f.name for f in result.schema.fields if isinstance(f.dataType, T.NumericType)]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    return result.select(
        F.lit(representation).alias("representation"), F.lit(axis).alias("axis"), (F.lit(task) if isinstance(task, str) else task.cast("string")).alias("task"),
        F.explode(pairs).alias("m"),
    ).select("representation", "axis", "task", "m.metric", "m.value")
