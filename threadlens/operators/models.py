"""Intent classifiers on TF-IDF: fitted by MLlib or as class means, scored as a join.

A fitted model is a table (term, one coefficient per label) and an intercept per label.
Scoring joins the texts' term weights with it and adds up one product per label: a row per
term of a text, whatever the number of labels, and no vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.functions import lexicons as lx
from threadlens.operators.features import (
    BASELINE, TermSettings, TfIdf, class_weights, fit_tfidf, fit_transform,
)
from threadlens.operators.sizing import broadcast_bounded
from threadlens.session import cut_lineage

_VECTOR_ROW = T.StructType([T.StructField("v", VectorUDT())])


def indexed_terms(terms: DataFrame) -> DataFrame:
    """Add ``idx`` 0.. in term order. Range partitions number their own terms and start
    after the partitions before them; only one count per partition meets in one task."""
    ranged = cut_lineage(
        terms.repartitionByRange("term").withColumn("__part", F.spark_partition_id())
    )
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__at"))
    place = F.row_number().over(W.partitionBy("__part").orderBy("term")) - 1
    return (
        ranged.withColumn("__place", place).join(before, "__part")
        .withColumn("idx", (F.col("__at") + F.col("__place")).cast("int"))
        .drop("__part", "__place", "__at")
    )


def sparse_vector(size: Column, indices: Column, values: Column) -> Column:
    """An MLlib sparse vector from sorted indices and values, built in the JVM by
    reading the vector's own field layout back from JSON (no Python UDF)."""
    row = F.struct(
        F.struct(
            F.lit(0).cast("tinyint").alias("type"), size.cast("int").alias("size"),
            indices.alias("indices"), values.alias("values"),
        ).alias("v")
    )
    return F.from_json(F.to_json(row), _VECTOR_ROW)["v"]


def to_vectors(
    docs: DataFrame, key: str, weights: DataFrame, terms: DataFrame, bound: int
) -> DataFrame:
    """``docs`` with a ``features`` vector; a text without known terms gets zeros.

    ``terms`` is (term, idx), ``bound`` rows at most."""
    small = broadcast_bounded(terms.select("term", "idx"), bound)
    size = terms.agg(F.count("*")).scalar()
    rows = weights.join(small, "term").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("cells")
    )
    joined = docs.join(rows, key, "left")
    cells = F.coalesce("cells", F.array().cast("array<struct<idx:int,weight:double>>"))
    return joined.withColumn(
        "features", sparse_vector(size, cells["idx"], cells["weight"])
    ).drop("cells")


@dataclass(frozen=True)
class IntentModel:
    """A fitted vocabulary, its coefficients (term, w: one number per label), and the
    labels with their intercepts. ``bound`` is the most terms it can have, if known, and
    ``solved`` the MLlib model the coefficients are from."""

    tfidf: TfIdf
    coefficients: DataFrame
    labels: tuple[str, ...]
    intercepts: tuple[float, ...]
    bound: int | None = None
    solved: LogisticRegressionModel | None = None

    def logits(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """Add ``logits``: per label the intercept and the text's weights times its
        coefficients, at twelve places so that the order of adding does not matter. A text
        without known terms has the intercepts."""
        weights = self.tfidf.transform(docs.select(key, text), key, text)
        own = broadcast_bounded(self.coefficients.withColumnRenamed("term", "__term"), self.bound)
        n = len(self.labels)
        sums = weights.join(own, F.col("term") == F.col("__term")).groupBy(
            F.col(key).alias("__key")
        ).agg(*(F.sum(F.col("weight") * F.col("w")[i]).alias(f"__z{i}") for i in range(n)))
        logits = F.array(
            *(F.round(F.coalesce(f"__z{i}", F.lit(0e0)) + F.lit(b), 12)
              for i, b in enumerate(self.intercepts))
        )
        scored = docs.join(sums, F.col(key) == F.col("__key"), "left").withColumn("logits", logits)
        return scored.drop("__key", *(f"__z{i}" for i in range(n)))

    def score(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """Add ``predicted_intent``, the first label with the largest logit, and
        ``prediction_confidence``, its softmax probability."""
        names = F.array(*[F.lit(x) for x in self.labels])
        top = F.array_max("logits")
        others = F.aggregate("logits", F.lit(0e0), lambda a, z: a + F.exp(z - top))
        place = F.array_position("logits", top).cast("int")
        return self.logits(docs, key, text).withColumns(
            {
                "predicted_intent": F.element_at(names, place),
                "prediction_confidence": F.lit(1e0) / others,
            }
        ).drop("logits")


def _labels(counts: DataFrame, label: str) -> tuple[list, tuple[str, ...]]:
    """The rows of a label list, small by nature, in label order."""
    rows = counts.orderBy(label).collect()
    labels = tuple(r[label] for r in rows)
    if len(labels) < 2:
        raise ValueError(f"need at least two classes to fit, found {list(labels)}")
    return rows, labels


def fit_intent(
    train: DataFrame, key: str, text: str, label: str,
    settings: TermSettings = BASELINE, max_iter: int = 1000, c: float = 1.0,
) -> IntentModel:
    """Class-balanced multinomial logistic regression on TF-IDF.

    Balanced class weights sum to n, and MLlib averages the loss, so the usual
    penalty C corresponds to regParam = 1 / (C n). The training vectors are written
    once to the shared folder: the optimiser passes over them many times. Without
    ``max_features`` every term counts, and the model holds a weight per term and
    class: set it where that outgrows the driver."""
    fitted, own = fit_transform(train, key, text, settings)
    terms = cut_lineage(indexed_terms(fitted.terms))
    n_terms = terms.count()
    weights = cut_lineage(class_weights(train, label))
    rows, labels = _labels(weights, label)
    names = F.array(*[F.lit(x) for x in labels])
    prepared = train.join(
        broadcast_bounded(weights.select(label, "weight"), len(labels)), label
    ).select(
        key, text, "weight",
        (F.array_position(names, F.col(label)) - 1).cast("double").alias("label"),
    )
    vectors = cut_lineage(
        to_vectors(prepared, key, own, terms, n_terms).select("features", "label", "weight")
    )
    n = sum(r["count"] for r in rows)
    lr = LogisticRegression(
        family="multinomial", weightCol="weight", elasticNetParam=0.0, regParam=1.0 / (c * n),
        standardization=False, maxIter=max_iter, tol=1e-6,
    )
    solved = lr.fit(vectors)
    # Plain lists: a session without Arrow refuses numpy's numbers.
    columns = solved.coefficientMatrix.toArray().T.tolist()
    table = train.sparkSession.createDataFrame(
        list(enumerate(columns)), "place int, w array<double>"
    )
    coefficients = cut_lineage(
        terms.join(table, F.col("idx") == F.col("place")).select("term", "w")
    )
    intercepts = tuple(float(b) for b in solved.interceptVector)
    return IntentModel(fitted, coefficients, labels, intercepts, n_terms, solved)


def fit_class_means(
    train: DataFrame, key: str, text: str, label: str, settings: TermSettings = BASELINE,
    sharpness: float = 10.0,
) -> IntentModel:
    """The classifier whose coefficients are the mean term weights of each class, times
    ``sharpness``. It is one aggregation, of any vocabulary and without a solver."""
    fitted = fit_tfidf(train, key, text, settings).stored()
    rows, labels = _labels(train.groupBy(label).agg(F.count("*").alias("n")), label)
    weights = fitted.transform(train, key, text, [label])
    means = [
        F.sum(F.when(F.col(label) == r[label], F.col("weight")).otherwise(0e0))
        * F.lit(sharpness) / F.lit(float(r["n"]))
        for r in rows
    ]
    coefficients = cut_lineage(weights.groupBy("term").agg(F.array(*means).alias("w")))
    return IntentModel(fitted, coefficients, labels, (0.0,) * len(labels), settings.max_features)


def majority_baseline(train: DataFrame, validation: DataFrame, label: str) -> DataFrame:
    """Predict the most frequent training label for every row (first name on a tie)."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label)))).scalar()
    return validation.withColumn("predicted_intent", top)


INTENT_LABELS: Sequence[str] = tuple(lx.INTENT_LABELS)
