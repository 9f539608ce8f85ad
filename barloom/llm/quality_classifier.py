"""Quality scores learnt from preference pairs (Bradley-Terry), thresholded at a score quantile.

A document has a worth, linear in its features; that one of two documents is preferred has the
probability sigmoid(worth - worth). Pairs of a good and a bad labelled document are compared by the
difference of their features, and the weights are the logistic regression of those differences without
intercept, in Spark ML. The threshold is a quantile of worths: below it lies the share ``LOSS`` of the good
training documents, or it lies half-way to the bad ones where these end before. Scores are sigmoids
shifted so that the threshold is at ``CUT``.

All labelled documents outside the held-out fold take part, on their whole texts: each of the more frequent label in
``PER_DOCUMENT`` comparisons, over which those of the other label are dealt in turn. Features are made once for all documents, in one
map of Arrow batches, and written; labels meet these numbers, not texts. Places in the order of a hash, and the quantiles, are found
by ranges, so that no task holds all of a label.

Null texts count as empty, and an empty text has all features 0. Labels are per doc_id, a repeated label
counting once, and bad if any is. Without labels of both kinds every document scores 0.5. Repeated rows
give repeated results, empty tables empty ones. Other columns are not read, so no score depends on them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.text_features import features
from barloom.session import written

PER_DOCUMENT = 4  # comparisons of a good document
LOSS = 0.005
CUT = 0.3
FOLDS = 5
ACCURACY = 10_000  # of the bracket around a quantile: it holds about six of that many parts of the values


def remainder(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good): all labels outside the held-out fold."""
    rows = labels.where(remainder() != 0).where("doc_id is not null and quality is not null")
    return rows.groupBy("doc_id").agg(F.min("quality").alias("good")).where("good in (0, 1)")


def placed(rows: DataFrame) -> DataFrame:
    """With ``place``, a row's number from 0 among those of its label by a hash of doc_id. Rows are numbered inside 4,096 ranges of the
    hash, and a range begins where those before it end."""
    by_hash = F.xxhash64(F.col("doc_id"), F.lit(7))
    told = rows.withColumn("range", F.shiftright(by_hash, 52))
    ranges = Window.partitionBy("good").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    before = told.groupBy("good", "range").count().select("good", "range", (F.sum("count").over(ranges) - F.col("count")).alias("before"))
    inside = Window.partitionBy("good", "range").orderBy(by_hash, "doc_id")
    told = told.withColumn("inside", F.row_number().over(inside) - 1).join(F.broadcast(before), ["good", "range"])
    return told.withColumn("place", F.col("before") + F.col("inside")).drop("range", "inside", "before")


def quantile(rows: DataFrame, value: Column, share: float) -> float | None:
    """What ``percentile`` gives, exactly, without a map of all values: those in a narrow bracket are counted off."""
    values, slack = rows.select(value.alias("v")).where("v is not null"), 2 / ACCURACY
    while True:
        low = F.percentile_approx("v", share - slack, ACCURACY) if share > slack else F.min("v")
        high = F.percentile_approx("v", share + slack, ACCURACY) if share + slack < 1 else F.max("v")
        n, low, high = values.agg(F.count("v"), low, high).first()
        if not n:
            return None
        at = share * (n - 1)
        under = values.where(F.col("v") < low).count()
        upto = F.sum("count").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + under
        near = values.where(F.col("v").between(low, high)).groupBy("v").count().withColumn("upto", upto)
        one, two = near.agg(*[F.min(F.when(F.col("upto") > place, F.col("v"))) for place in (math.floor(at), math.ceil(at))]).first()
        if under <= math.floor(at) and one is not None and two is not None:
            return one if one == two else (math.ceil(at) - at) * one + (at - math.floor(at)) * two
        slack *= 8


@dataclass
class Model:
    weights: list[float]
    threshold: float

    def worth(self) -> Column:
        """Of the numbers in column ``x``."""
        return sum((w * F.col("x")[i] for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self) -> Column:
        return 1 / (1 + F.exp(-(self.worth() - self.threshold) - math.log(CUT / (1 - CUT))))


def described(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, digest, x, ...) of all documents, written."""
    told = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), features("text").alias("x"), *more)
    return written(told, "features")


def fit(told: DataFrame, labels: DataFrame, loss: float = LOSS) -> Model | None:
    """``told``: documents by ``described``."""
    # of texts that share an id the one of least digest, so that reruns agree
    rows = told.select("doc_id", "digest", "x").join(labelled(labels), "doc_id").groupBy("doc_id", "good").agg(F.min_by("x", "digest").alias("x"))
    rows = written(rows, "labelled-features")
    counts = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    if len(counts) < 2:
        return None
    numbered = written(placed(rows), "placed")
    many = int(counts[1] >= counts[0])
    told_more = numbered.where(f"good = {many}").select(
        F.col("x").alias("x_many"), "place", F.explode(F.sequence(F.lit(0), F.lit(PER_DOCUMENT - 1))).alias("turn")
    ).withColumn("other", F.pmod(F.col("place") * PER_DOCUMENT + F.col("turn") * 7919, F.lit(counts[1 - many])))
    told_less = numbered.where(f"good = {1 - many}").select(F.col("x").alias("x_few"), F.col("place").alias("other"))
    better, worse = ("x_many", "x_few") if many else ("x_few", "x_many")
    # every second pair is told the other way round, so that both outcomes occur
    sign = F.when((F.col("place") + F.col("turn")) % 2 == 0, 1.0).otherwise(-1.0)
    pairs = told_more.join(told_less, "other").withColumn("sign", sign).select(
        F.zip_with(better, worse, lambda a, b: a - b).alias("diff"), "sign",
    ).select(
        array_to_vector(F.transform("diff", lambda d: d * F.col("sign"))).alias("features"),
        (F.col("sign") > 0).cast("double").alias("label"),
    )
    lr = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=60)
    weights = [float(w) for w in lr.fit(written(pairs, "pairs")).coefficients]
    model = Model(weights, 0.0)
    low, high = (quantile(rows.where(f"good = {g}"), model.worth(), share) for g, share in ((1, loss), (0, 1 - loss)))
    model.threshold = low if high >= low else (low + high) / 2
    return model


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    told = described(docs)
    model = fit(told, labels, **options)
    score = model.score() if model else F.lit(0.5)
    return told.select("doc_id", (remainder() == 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns; they are written once beside their features, and not shuffled."""
    told = described(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    model = fit(told, labels, **options)
    return (told.where(model.score() >= CUT) if model else told).select("row.*")
