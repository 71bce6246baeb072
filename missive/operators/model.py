"""The linear text model: TF-IDF features, softmax regression, and where its decisions come from."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.functions import text as T
from missive.functions.order import numbered_in_order
from missive.sources.tables import remove_path, removed, shared_folder, written

MIN_DF, NGRAMS, C = 2, 2, 4.0
#: shapes of values that no vocabulary may hold: long digit runs, secrets' prefixes, symbol mixes, codes; fixed values
VALUE_SHAPES = [
    r"\d{4,}",
    r"(?:sk|pk|tok|ghp|gho|xox)[_-]\w+",
    r"[A-Za-z]{3,}[#$%^&*!][A-Za-z0-9]*",
    r"\b[A-Z]{2,}-\d+(?:-[A-Z0-9]+)+",
]
#: terms of a model at most
MOST_TERMS = 1 << 18


@dataclass
class Artifact:
    """vocab(term, idx, idf), coef(class, idx, w), bias(class, b): three small tables."""

    vocab: DataFrame
    coef: DataFrame
    bias: DataFrame

    def save(self, path: str) -> None:
        for name in ("vocab", "coef", "bias"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def removed(self) -> None:
        """Drop the tables that training wrote."""
        for df in (self.vocab, self.coef):
            removed(df)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Artifact:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("vocab", "coef", "bias")))


def vectors(rows: DataFrame, vocab: DataFrame, key: str = "message_id", text: str = "masked_text") -> DataFrame:
    """(key, f): the known n-grams of each row as (idx, term, w) by idx; sublinear TF, smoothed idf, unit length. Rows without any are left out."""
    # dealt by their keys while they are text, and the vocabulary is bounded: so no entry is shuffled, by term or by key
    tokens = rows.select(key, text).repartition(key).select(key, T.tokenize(F.coalesce(text, F.lit(""))).alias("_t"))
    counts = tokens.select(key, F.explode(T.ngrams(F.col("_t"), NGRAMS)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    raw = counts.join(F.broadcast(vocab), "term").select(key, F.struct("idx", "term", ((F.log("tf") + 1.0) * F.col("idf")).alias("v")).alias("x"))
    lists = raw.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))
    return lists.withColumn("_norm", norm).select(key, F.transform("x", lambda x: F.struct(x["idx"].alias("idx"), x["term"].alias("term"), (x["v"] / F.col("_norm")).alias("w"))).alias("f"))


def features(rows: DataFrame, vocab: DataFrame, key: str = "message_id", text: str = "masked_text") -> DataFrame:
    """(key, idx, term, w): ``vectors``, one row an entry."""
    return vectors(rows, vocab, key, text).select(key, F.inline("f"))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores; a single score is one class's logit against the other."""
    top = F.array_max(scores)
    exps = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(exps, F.lit(0.0), lambda a, e: a + e)
    p = 1.0 / (1.0 + F.exp(-F.get(scores, F.lit(0))))
    return F.when(F.size(scores) == 1, F.array(1.0 - p, p)).otherwise(F.transform(exps, lambda e: e / total))


def scores(entries: DataFrame, rows: DataFrame, artifact: Artifact, key: str = "message_id") -> DataFrame:
    """(key, class, s): linear scores of all rows, also of those without a known feature."""
    dots = entries.join(artifact.coef, "idx").groupBy(key, "class").agg(F.sum(F.col("w") * F.col("coef")).alias("dot"))
    every = rows.select(key).distinct().crossJoin(F.broadcast(artifact.bias))
    return every.join(dots, [key, "class"], "left").select(key, "class", (F.col("b") + F.coalesce("dot", F.lit(0.0))).alias("s"))


def predictions(rows: DataFrame, artifact: Artifact, key: str = "message_id", text: str = "masked_text") -> DataFrame:
    """(key, label, confidence, margin, distribution): classes by probability, rounded to four places."""
    s = scores(features(rows, artifact.vocab, key, text), rows, artifact, key)
    made = s.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("class"), "s"))).alias("c"))
    p = softmax(F.transform("c", lambda x: x["s"]))
    pairs = F.transform(F.arrays_zip(F.transform("c", lambda x: x["class"]).alias("k"), p.alias("p")), lambda z: F.struct((-z["p"]).alias("n"), z["k"].alias("label"), F.round(z["p"], 4).alias("p")))
    made = made.withColumn("d", F.array_sort(pairs))
    first, second = F.get("d", F.lit(0)), F.get("d", F.lit(1))
    return made.select(key, first["label"].alias("label"), first["p"].alias("confidence"), (first["p"] - F.coalesce(second["p"], F.lit(0.0))).alias("margin"), F.transform("d", lambda x: F.struct(x["label"].alias("label"), x["p"].alias("p"))).alias("distribution"))


def with_predictions(rows: DataFrame, artifact: Artifact, key: str = "message_id") -> DataFrame:
    p = predictions(rows, artifact, key).select(key, F.col("label").alias("model_category"), F.col("confidence").alias("model_confidence"), F.col("margin").alias("model_margin"))
    return rows.join(p, key, "left")


def explain(rows: DataFrame, artifact: Artifact, k: int = 5, key: str = "message_id", text: str = "masked_text") -> DataFrame:
    """(key, feature, contribution, rank): what pushed each row most towards its label; contributions equal to nine places by name."""
    entries = features(rows, artifact.vocab, key, text)
    label = predictions(rows, artifact, key, text).select(key, F.col("label").alias("class"))
    parts = entries.join(label, key).join(artifact.coef, ["idx", "class"]).select(key, F.col("term").alias("feature"), (F.col("w") * F.col("coef")).alias("contribution"))
    order = Window.partitionBy(key).orderBy(F.desc(F.round("contribution", 9)), "feature")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("contribution", F.round("contribution", 4))


def least_df(df: DataFrame, most: int) -> int:
    """The least document frequency that at most ``most`` terms reach, from the counts of equal frequencies."""
    sizes = df.groupBy("df").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(Window.orderBy(F.desc("df"))))
    return sizes.filter(F.col("n") <= most).agg(F.min("df")).head()[0] or most + 1


def vocabulary(rows: DataFrame, text: str = "masked_text", min_df: int = MIN_DF, key: str = "message_id", most: int = MOST_TERMS, times: str | None = None) -> DataFrame:
    """(term, idx, idf) of the n-grams in at least ``min_df`` rows, numbered in their order; a written table.

    Where more than ``most`` are, ``min_df`` rises until they aren't: the weights of a model
    are held whole in each task, so their number must not grow with the rows. ``times``: a
    column that says how many rows each row stands for.
    """
    rows = rows.select(key, text, (F.lit(1) if times is None else F.col(times)).cast("long").alias("_times"))
    grams = rows.select(key, "_times", F.explode(F.array_distinct(T.ngrams(T.tokenize(F.coalesce(text, F.lit(""))), NGRAMS))).alias("term"))
    n = rows.agg(F.coalesce(F.sum("_times"), F.lit(0))).head()[0]
    df = written(grams.groupBy("term").agg(F.sum("_times").alias("df")).filter(F.col("df") >= min_df), "document-frequencies")
    kept = df if df.count() <= most else df.filter(F.col("df") >= least_df(df, most))
    numbered = numbered_in_order(kept, [], F.left("term", F.lit(3)), [F.col("term")], "idx")
    out = written(numbered.select("term", (F.col("idx") - 1).cast("int").alias("idx"), (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1.0).alias("idf")), "vocabulary")
    removed(df)
    return out


def leaks(vocab: DataFrame) -> DataFrame:
    """Vocabulary entries shaped like a value instead of a word; training must not go on with any."""
    return vocab.filter(F.col("term").rlike("|".join(VALUE_SHAPES)))


def _sparse(rows: DataFrame, vocab: DataFrame, size: int, labels: list[str], key: str) -> tuple[DataFrame, str]:
    """(label, _times, features) with labels by their place in ``labels`` and sparse vectors, and the folder they lie in.

    Spark reads sparse vectors from text lines "label idx:w idx:w"; the lines are made by
    columns, so no row passes through Python and no vector is as wide as the vocabulary.
    A line has one number beside its vector: the label's place plus _times the labels.
    """
    number = F.create_map(*(F.lit(x) for i, c in enumerate(labels) for x in (c, i)))
    both = number[F.col("label")] + F.col("_times") * len(labels)
    entries = F.transform("f", lambda x: F.concat((x["idx"] + 1).cast("string"), F.lit(":"), x["w"].cast("string")))
    lines = rows.select(key, "label", "_times").join(vectors(rows, vocab, key), key, "left").select(F.concat_ws(" ", both.cast("string"), F.array_join(F.coalesce(entries, F.array().cast("array<string>")), " ")).alias("value"))
    path = f"{shared_folder(rows.sparkSession)}/missive-vectors-{uuid.uuid4().hex}"
    lines.write.text(path)
    read = rows.sparkSession.read.format("libsvm").option("numFeatures", size).load(path)
    return read.withColumns({"label": F.pmod("label", F.lit(float(len(labels)))), "_times": F.floor(F.col("label") / len(labels))}), path


def train(rows: DataFrame, max_iter: int = 200, min_df: int = MIN_DF, most: int = MOST_TERMS, key: str = "message_id", times: str | None = None) -> Artifact:
    """Softmax regression on rows with ``label`` and ``masked_text``; classes weigh alike.

    ``times``: a column that says how many rows each row stands for.

    Each iteration sums the gradient of sparse rows in a tree over the tasks. The weights,
    at most ``most`` terms by the number of classes, are all that the driver holds. Rows
    without a label are left out; a row without a known term counts for its class alone.
    ValueError: no row, a single class, or a vocabulary with terms shaped like values.
    ``Artifact.removed`` drops the tables.
    """
    from pyspark.ml.classification import LogisticRegression

    spark = rows.sparkSession
    rows = rows.filter("label is not null").select(key, "label", "masked_text", (F.lit(1) if times is None else F.col(times)).cast("long").alias("_times"))
    n = {r[0]: r[1] for r in rows.groupBy("label").agg(F.sum("_times")).collect()}
    labels, total = sorted(n), sum(n.values())
    if len(labels) < 2:
        raise ValueError("training needs rows of two classes at least")
    vocab = vocabulary(rows, min_df=min_df, key=key, most=most, times="_times")
    if not leaks(vocab).isEmpty():
        removed(vocab)
        raise ValueError("the vocabulary holds terms shaped like values")
    size = vocab.count()
    data, path = _sparse(rows, vocab, max(size, 1), labels, key)
    weight = F.create_map(*(F.lit(x) for i, c in enumerate(labels) for x in (float(i), total / (len(labels) * n[c]))))
    fit = LogisticRegression(weightCol="weight", regParam=1.0 / (C * total), elasticNetParam=0.0, standardization=False, family="multinomial", maxIter=max_iter, tol=1e-8)
    fitted = fit.fit(data.withColumn("weight", weight[F.col("label")] * F.col("_times")))
    remove_path(spark, path)
    matrix = fitted.coefficientMatrix.toArray()
    at, idx = np.nonzero(matrix)
    coef = pa.table({"class": pa.array(np.array(labels, object)[at], pa.string()), "idx": pa.array(idx.astype(np.int32)), "coef": pa.array(matrix[at, idx])})
    bias = spark.createDataFrame(list(zip(labels, map(float, fitted.interceptVector))), "class string, b double")
    return Artifact(vocab, written(spark.createDataFrame(coef), "coef"), bias)


def folds(rows: DataFrame, n: int = 5, by_template: bool = True) -> DataFrame:
    """Add fold: whole templates together, or single rows by hash."""
    key = T.template_hash(T.canonical(F.col("masked_text"))) if by_template else F.col("message_id")
    return rows.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def cross_validated(rows: DataFrame, n: int = 5, by_template: bool = True) -> DataFrame:
    """(message_id, label, fold, predicted): each row's label by a model that hasn't seen its fold.

    A fold without rows, or whose other rows show fewer than two classes, gives none.
    """
    rows = written(folds(rows, n, by_template).select("message_id", "label", "masked_text", "fold"), "folds")
    seen = {(r[0], r[1]) for r in rows.filter("label is not null").groupBy("fold", "label").count().collect()}
    parts = []
    for k in sorted({f for f, _ in seen}):
        if len({label for f, label in seen if f != k}) < 2:
            continue
        artifact = train(rows.filter(F.col("fold") != k))
        test = rows.filter(F.col("fold") == k)
        p = predictions(test, artifact).select("message_id", F.col("label").alias("predicted"))
        parts.append(written(test.select("message_id", "label", "fold").join(p, "message_id"), "fold"))
        artifact.removed()
    removed(rows)
    empty = rows.sparkSession.createDataFrame([], "message_id string, label string, fold int, predicted string")
    return reduce(DataFrame.unionByName, parts) if parts else empty
