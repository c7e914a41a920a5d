"""Secret scans whose false positives are removed by a random forest.

Candidates are long tokens of a whole text: with a digit from ``MIN_CHARS`` characters, any from ``LONG_CHARS``. Each is
described by its length, its characters and their transitions (how likely the corpus finds each character after the one
before it, from counts over all texts), by how much of it a dictionary covers, and by how often labelled candidates at the
same path, after the same word and mark and before the same word were secrets (shrunk to the overall rate, without the
candidate itself). A random forest learns from labelled findings to tell secrets from the rest.

The forest is fitted on at most ``MAX_TRAINING`` labelled findings (the smallest hashes of place and token); counts, rates
and scans cover everything. The dictionary is the vocabulary of a public tokenizer, whose size does not depend on the data.

Defined cases: null text counts as empty; a null path is a path of its own; rows equal in id and text are scanned one by
one; without labelled findings of both kinds every candidate has the rate of the labels (0.5 without any); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import bounded_sample, read, small_batches, some, stored, text_of
from trainlake.llm.textkit import slices

DICTIONARY = "/opt/tokenizers/word_bpe_49k.json"
MIN_CHARS = 12
LONG_CHARS = 20
MAX_TRAINING = 20000
TREES, DEPTH = 40, 6
SECRET_FROM = 0.5

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_CHARS)
_DIGIT = re.compile(r"\d")
_BEFORE = re.compile(r"(\w*)(\W*)$")
_AFTER = re.compile(r"\W*(\w*)")
_LETTERS = re.compile(r"[a-z]{3,}")
_CONTEXT = 48  # characters looked at on each side for the neighbouring words
_KINDS = 97  # the printable characters of ASCII, and all others
_SLICE_BYTES = 1 << 20


def _codes(data: bytes) -> np.ndarray:
    values = np.frombuffer(data, dtype=np.uint8).astype(np.int64) - 32
    return np.where((values >= 0) & (values < _KINDS - 1), values, _KINDS - 1)


# ---- Candidates ---------------------------------------------------------------------------------
def candidates_in(text: str):
    """(start, end, token, word before, mark before, word after) of every candidate."""
    for found in _CANDIDATE.finditer(text):
        token = found.group()
        if len(token) < LONG_CHARS and not _DIGIT.search(token):
            continue
        start, end = found.span()
        word, mark = _BEFORE.search(text[max(0, start - _CONTEXT) : start]).groups()
        after = _AFTER.match(text[end : end + _CONTEXT]).group(1)
        yield start, end, token, word.lower(), " ".join(mark.split()), after.lower()


def candidates(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate of every text."""

    def scan(batches):
        for batch in batches:
            rows = []
            for doc_id, place, text in zip(batch["doc_id"], batch["path"], batch["text"]):
                rows += [(doc_id, place, *found) for found in candidates_in(text)]
            yield from some(rows, ["doc_id", "path", "start", "end", "token", "before", "mark", "after"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(path.cast("string"), F.lit("\0")).alias("path"), text_of(text_col).alias("text"))
    return rows.mapInPandas(
        scan, "doc_id long, path string, start long, end long, token string, before string, mark string, after string"
    )


def transitions(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log2 P(next character | character) over all texts; the table has a fixed size."""

    def count(batches):
        total = np.zeros(_KINDS * _KINDS, dtype=np.int64)
        for batch in batches:
            encoded = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            for first, last in slices([len(t) for t in encoded], _SLICE_BYTES):
                codes = _codes(b"\n".join(encoded[first:last]))
                total += np.bincount(codes[:-1] * _KINDS + codes[1:], minlength=len(total))
        pairs = np.flatnonzero(total)
        yield pd.DataFrame({"pair": pairs, "n": total[pairs]})

    counted = docs.select(text_of(text_col).alias("text")).mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.full(_KINDS * _KINDS, 0.5)
    for row in counted.collect():  # at most 97 * 97 rows
        counts[row["pair"]] += row["n"]
    counts = counts.reshape(_KINDS, _KINDS)
    return np.log2(counts / counts.sum(1, keepdims=True))


def dictionary(path: str = DICTIONARY) -> frozenset[str]:
    """The words of three letters or more in a tokenizer's vocabulary."""
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    words = (n.removesuffix("</w>").lower() for n in names)
    return frozenset(w for w in words if len(w) >= 3 and w.isascii() and w.isalpha())


def coverage(token: str, words: frozenset[str], longest: int) -> tuple[float, int]:
    """(share of the characters that longest matches from the left cover, length of the longest word found)."""
    covered, most = 0, 0
    for run in _LETTERS.finditer(token.lower()):
        letters, at = run.group(), 0
        while at + 3 <= len(letters):
            size = next((s for s in range(min(longest, len(letters) - at), 2, -1) if letters[at : at + s] in words), 0)
            covered, most, at = covered + size, max(most, size), at + max(1, size)
    return covered / len(token), most


def shape(token: str, logs: np.ndarray, words: frozenset[str], longest: int) -> list[float]:
    """Length, shares of digits, upper case, lower case and others, distinct characters, entropy, changes of kind, mean and
    least transition, dictionary coverage and longest word."""
    codes = _codes(token.encode())
    counts = np.unique(codes, return_counts=True)[1] / len(codes)
    kind = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in token]
    steps = logs[codes[:-1], codes[1:]]
    return [
        math.log2(len(token)), kind.count(0) / len(kind), kind.count(1) / len(kind), kind.count(2) / len(kind), kind.count(3) / len(kind),
        len(counts) / len(codes), float(-(counts * np.log2(counts)).sum()), sum(a != b for a, b in zip(kind, kind[1:])) / len(kind),
        float(steps.mean()), float(steps.min()), *map(float, coverage(token, words, longest)),
    ]


# ---- Rates and forest ---------------------------------------------------------------------------
def _with_rates(rows: DataFrame, strength: float = 4.0) -> DataFrame:
    """Add the shrunk rate of secrets among the labelled training rows that share a path, word or mark."""
    learned = F.col("training") & F.col("label").isNotNull()
    overall = rows.where(learned).agg(F.avg("label")).first()[0]
    prior = 0.5 if overall is None else float(overall)
    for column in ("path", "before", "mark", "after"):
        sums = rows.where(learned).groupBy(column).agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("seen"))
        own, one = F.when(learned, F.col("label")).otherwise(0.0), F.when(learned, 1).otherwise(0)
        hits, seen = F.coalesce("hits", F.lit(0.0)) - own, F.coalesce("seen", F.lit(0)) - one
        rows = rows.join(sums, column, "left").withColumn(f"rate_{column}", (hits + strength * prior) / (seen + strength)).drop("hits", "seen")
    return rows


def scan_secrets(
    docs: DataFrame, path: Column, labels: Column, training: Column, id_col: str = "doc_id", text_col: str = "text",
    dictionary_path: str = DICTIONARY, max_training: int = MAX_TRAINING,
) -> DataFrame:
    """One row per candidate: doc_id, path, start, end, token, label, training, probability. ``labels`` is an expression
    over the columns of a candidate (1.0 secret, 0.0 none, null unknown), ``training`` one over doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    words = dictionary(dictionary_path)
    shared = spark.sparkContext.broadcast((transitions(docs, text_col), words, max(map(len, words))))

    @F.pandas_udf("array<double>")
    def shape_of(tokens: pd.Series) -> pd.Series:
        logs, known, longest = shared.value
        return tokens.map(lambda t: shape(t, logs, known, longest))

    found = candidates(docs, path, id_col, text_col).withColumn("shape", shape_of("token"))
    found = stored(found.withColumn("label", labels).withColumn("training", training), "candidates")
    rates = F.array(*[F.col(f"rate_{c}") for c in ("path", "before", "mark", "after")])
    rows = stored(_with_rates(found).withColumn("vector", F.concat("shape", rates)), "described-candidates")

    labelled = rows.where("training AND label IS NOT NULL")
    sample = stored(bounded_sample(labelled, max_training, "doc_id", "start", "token").select("label", "vector"), "labelled")
    kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(kinds) < 2:
        rate = next(iter(kinds), 0.5)
        scored = rows.withColumn("probability", F.lit(float(rate)))
    else:
        forest = RandomForestClassifier(featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt")
        model = forest.fit(sample.coalesce(1).withColumn("features", array_to_vector("vector")))
        scored = model.transform(rows.withColumn("features", array_to_vector("vector")))
        scored = scored.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", F.nullif("path", F.lit("\0")).alias("path"), "start", "end", "token", "label", "training", "probability")


def format_labels() -> Column:
    """Labels of the findings that a format settles: keys of a known provider, long hexadecimal values that are assigned to a
    name of a secret; numbers and plain words are none. Everything else has no label and is left to the forest."""
    token, before = F.col("token"), F.col("before")
    assigned = before.isin("password", "token", "secret", "api_key") & F.col("mark").rlike("^[=:] ?[\"']?$")
    secret = token.rlike("^AKIA[0-9A-Z]{16}$") | (assigned & token.rlike("^[0-9a-f]{16,}$"))
    nothing = token.rlike("^[0-9]+$") | token.rlike("^[A-Za-z]+$")
    return F.when(secret, 1.0).when(nothing, 0.0)


def op5_secret_scans(spark, sf_dir):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    found = scan_secrets(read(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), format_labels(), ~held_out)
    return found.select(
        "doc_id", "path", "start", "end", F.sha2("token", 256).alias("token_sha256"), "label", (~F.col("training")).alias("held_out"),
        "probability", (F.col("probability") >= SECRET_FROM).alias("is_secret"),
    )
