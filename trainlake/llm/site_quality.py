"""Quality by hierarchical empirical Bayes: a document classifier with host and path posteriors.

A logistic regression on shape features of the whole text gives every document a probability. Sites (hosts and the
paths within them) are summarised by grouped aggregation over all documents, a label counting as itself and an unlabelled
document as its probability. The rate of a path is shrunk towards its host and the host towards the corpus, with Beta
priors whose strengths come from the spread between hosts and between the paths of a host (method of moments): a site
with few documents has the rate of its parent, one with many its own. The document's evidence is the classifier's log odds
beyond the base rate, added to the log odds of its path without the document itself.

The classifier is fitted on at most ``MAX_TRAINING`` labelled documents (those with the smallest hash of their id); all
else covers every document.

Defined cases: null text counts as empty, whose features are all 0; a null host or path is a site of its own; null
labels are ignored, several labels of an id are averaged; without any label every document has probability 0.5 and is
kept; repeated rows count and are judged one by one; an empty table gives no rows; other columns are not read, and kept
by the stage.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import bounded_sample, read, small_batches, stored, text_of
from trainlake.llm.textkit import runs, slices, word_hashes

MAX_TRAINING = 20000
KEEP_FROM = 0.5

_SLICE_BYTES = 1 << 20
_BYTE_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"-()", b"#$%&*!|@~^+=<>[]{}\\/_`", b"\n", b" \t\r"]
_CLASS_OF = np.full(256, len(_BYTE_CLASSES), dtype=np.int64)  # the rest: beyond ASCII
for _i, _members in enumerate(_BYTE_CLASSES):
    _CLASS_OF[list(_members)] = _i
N_FEATURES = len(_BYTE_CLASSES) + 1 + 6


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: shares of byte classes, length, word length, repetition of words and of pairs, sentence ends."""
    found = np.zeros((len(texts), N_FEATURES))
    kinds = len(_BYTE_CLASSES) + 1
    for i, text in enumerate(texts):
        if text:
            found[i, :kinds] = np.bincount(_CLASS_OF[np.frombuffer(text, dtype=np.uint8)], minlength=kinds) / len(text)
    hashes, limits = word_hashes(texts)
    n = np.diff(limits)
    some = np.maximum(n, 1)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), n)

    def distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.unique((of << np.uint64(44)) | (values >> np.uint64(20)), return_counts=True)
        of = (keys >> np.uint64(44)).astype(np.int64)
        most = np.zeros(len(texts))
        np.maximum.at(most, of, counts)
        return np.bincount(of, minlength=len(texts)), most

    words, most = distinct(hashes, owner)
    pairs = runs(hashes, 2)
    inside = owner[1:] == owner[:-1]
    pair_kinds, _ = distinct(pairs[inside], owner[1:][inside])
    same = np.bincount(owner[1:][inside & (hashes[1:] == hashes[:-1])].astype(np.int64), minlength=len(texts))
    sizes = np.array([len(t) for t in texts])
    found[:, kinds:] = np.column_stack([
        np.log1p(n), sizes / some, words / some, most / some, pair_kinds / np.maximum(n - 1, 1), same / some,
    ])
    found[sizes == 0] = 0
    return found


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> dict:
    """Logistic regression by Newton steps on scaled features; a model without rows is undecided."""
    if not len(x):
        return {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "weights": np.zeros(N_FEATURES + 1), "rate": 0.5}
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    weights = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ weights)
        weights = weights + step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "weights": weights, "rate": float(np.clip(y.mean(), 1e-3, 1 - 1e-3))}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -20, 20) @ model["weights"][1:] + model["weights"][0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _featured(texts) -> list[np.ndarray]:
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    return [row for first, last in slices([len(t) for t in encoded], _SLICE_BYTES) for row in features(encoded[first:last])]


def with_features(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(_featured(texts))

    return rows.withColumn("features", of("body"))


def _classified(rows: DataFrame, model: dict) -> DataFrame:
    """Add ``classifier`` from ``features``; a linear form, so Spark evaluates it itself."""
    terms = F.lit(float(model["weights"][0]))
    for i in range(N_FEATURES):
        z = (F.get("features", F.lit(i)) - F.lit(float(model["mean"][i]))) / F.lit(float(model["scale"][i]))
        terms = terms + F.least(F.greatest(z, F.lit(-20.0)), F.lit(20.0)) * F.lit(float(model["weights"][i + 1]))
    odds = F.least(F.greatest(terms, F.lit(-30.0)), F.lit(30.0))
    return rows.withColumn("classifier", 1 / (1 + F.exp(-odds)))


def _strength(groups: DataFrame, mean: Column, centre: Column) -> float:
    """The strength of a Beta prior around ``centre``, from the spread of the group means beyond chance."""
    chance = centre * (1 - centre)
    row = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (mean - centre) ** 2).alias("spread"), F.sum(chance).alias("noise"),
        F.sum(F.col("n") * chance).alias("total"),
    ).first()
    if not row["n"]:
        return 1.0
    between = (row["spread"] - row["noise"]) / row["n"]
    whole = row["total"] / row["n"]
    return float(min(1e6, max(1.0, whole / between - 1))) if between > 0 else 1e6


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, good, host_posterior, path_strength) of all sites from rows (host, path, value), and the rate of
    the corpus."""
    paths = stored(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = min(1 - 1e-3, max(1e-3, total["good"] / total["n"])) if total["n"] else 0.5
    own = F.col("good") / F.col("n")
    strength = _strength(hosts, own, F.lit(rate))
    shrunk = hosts.select("host", ((F.col("good") + strength * rate) / (F.col("n") + strength)).alias("host_posterior"))
    sites = paths.join(shrunk, "host")
    within = _strength(sites, own, F.col("host_posterior"))
    return sites.withColumn("path_strength", F.lit(within)), rate


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _judged(rows: DataFrame, sites: DataFrame, base_rate: float) -> DataFrame:
    """Add host_posterior, path_posterior and posterior to rows with host, path, classifier and value."""
    without = (F.col("good") - F.col("value") + F.col("path_strength") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("path_strength"))
    base = math.log(base_rate / (1 - base_rate))
    return (
        rows.join(sites, ["host", "path"])
        .withColumn("path_posterior", without)
        .withColumn("posterior", 1 / (1 + F.exp(-(_log_odds(F.col("path_posterior")) + _log_odds(F.col("classifier")) - base))))
    )


def _sited(docs: DataFrame, host: Column, path: Column, id_col: str, text_col: str, row: bool = False) -> DataFrame:
    kept = [F.struct(F.col("*")).alias("row")] if row else []

    def named(c):
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))

    return docs.select(F.col(id_col).cast("long").alias("id"), named(host).alias("host"), named(path).alias("path"), text_of(text_col).alias("body"), *kept)


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label): one label for each labelled id."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    return known.groupBy("id").agg(F.avg("label").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")


def _model(docs: DataFrame, labels: DataFrame, host, path, id_col, text_col, label_col, most):
    """(all documents with features and label, model, sites)."""
    small_batches(docs.sparkSession)
    known = _known(labels, id_col, label_col)
    rows = with_features(_sited(docs, host, path, id_col, text_col)).drop("body")
    rows = stored(rows.join(known, "id", "left"), "features")
    sample = bounded_sample(rows.where("label IS NOT NULL"), most, "id", "label").select("features", "label").collect()
    x = np.array([r["features"] for r in sample]).reshape(len(sample), N_FEATURES)
    model = fit(x, np.array([r["label"] for r in sample]))
    judged = _classified(rows, model).withColumn("value", F.coalesce("label", "classifier"))
    sites, _ = site_posteriors(judged.select("host", "path", "value"))
    return judged, model, stored(sites, "sites")


def quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", max_training: int = MAX_TRAINING,
) -> DataFrame:
    """One row per document: doc_id, host, path, classifier, host_posterior, path_posterior, posterior."""
    judged, model, sites = _model(docs, labels, host, path, id_col, text_col, label_col, max_training)
    names = [F.when(F.col(c) != "null", F.expr(f"substring({c}, 2)")).alias(c) for c in ("host", "path")]
    return _judged(judged, sites, model["rate"]).select(
        F.col("id").alias("doc_id"), *names, "classifier", "host_posterior", "path_posterior", "posterior"
    )


def op1_quality_classifier(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = quality(docs, labels, F.col("source"), F.col("lang"))
    return found.withColumn("kept", F.col("posterior") >= KEEP_FROM)


def quality_stage(spark, docs, sf_dir):
    """The documents with a posterior of at least ``KEEP_FROM``, the rows that op1 keeps; texts are read a second time and
    meet the labels by id."""
    labels = read(spark, sf_dir, "labels")
    judged, model, sites = _model(docs, labels, F.col("source"), F.col("lang"), "doc_id", "text", "quality", MAX_TRAINING)
    again = _classified(with_features(_sited(docs, F.col("source"), F.col("lang"), "doc_id", "text", row=True)).drop("body"), model)
    again = again.join(_known(labels, "doc_id", "quality"), "id", "left").withColumn("value", F.coalesce("label", "classifier"))
    return _judged(again, sites, model["rate"]).where(F.col("posterior") >= KEEP_FROM).select("row.*")
