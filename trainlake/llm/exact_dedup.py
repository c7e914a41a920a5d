"""Exact duplicates by recipes of content-defined chunks.

Every text is cut into chunks where a rolling hash of its bytes says so. A document's recipe is the ordered list of
its chunk digests. Only recipes that several documents share can be copies: their chunks, and no others, are
deduplicated to identifiers, and byte comparison (grouping by digest and bytes) shows whether a digest stands for
one chunk or several. Documents are then compared by their lists of identifiers. A long document moves as a few
digests; a chunk's bytes move once per task and not once per copy.

Defined cases: null text counts as empty and all empty texts are equal; a null id is larger than any other; rows that
are equal in text and id are told apart by their place, so exactly one row of a group stays; an empty table gives no
rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import read, small_batches, some, stored, text_of
from trainlake.llm.textkit import cut_points

WHITE_SPACE = b" \t\n\v\f\r"
DIGEST_BYTES = 16


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, WHITE_SPACE)


def _chunks(data: bytes) -> Iterator[bytes]:
    first = 0
    for end in cut_points(data):
        yield data[first:end]
        first = end


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def recipes(docs: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(doc_id, text) to (doc_id, code_points, text_sha256, recipe)."""

    def cut(batches):
        for batch in batches:
            texts = [normalised(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "code_points": [len(t) for t in batch["text"]],
                "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
                "recipe": [b"".join(_digest(c, digest_bytes) for c in _chunks(t)) for t in texts],
            })

    return docs.mapInPandas(cut, "doc_id long, code_points long, text_sha256 string, recipe binary")


def chunk_rows(docs: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(text) to one row (text_sha256, seq, digest, chunk) per chunk."""

    def cut(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                data = normalised(text)
                sha = hashlib.sha256(data).hexdigest()
                rows += [(sha, i, _digest(c, digest_bytes), c) for i, c in enumerate(_chunks(data))]
            yield from some(rows, ["text_sha256", "seq", "digest", "chunk"])

    return docs.mapInPandas(cut, "text_sha256 string, seq int, digest binary, chunk binary")


def _several(docs: DataFrame, found: DataFrame, digest_bytes: int) -> DataFrame:
    """(digest, chunk, variant) for digests that stand for more than one chunk; hardly ever a row."""
    shared = found.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = F.sequence(F.lit(0), F.expr(f"length(recipe) div {digest_bytes} - 1"))
    wanted = (
        shared.where(F.length("recipe") > 0)
        .select(F.explode(F.transform(places, lambda i: F.substr("recipe", i * digest_bytes + 1, F.lit(digest_bytes)))).alias("digest"))
        .distinct()
    )
    chunks = chunk_rows(docs.select("text"), digest_bytes).select("digest", "chunk")
    verified = chunks.join(wanted, "digest", "left_semi").distinct()
    variants = verified.groupBy("digest").agg(F.sort_array(F.collect_list("chunk")).alias("chunks"))
    return variants.where(F.size("chunks") > 1).select("digest", F.posexplode("chunks").alias("variant", "chunk"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks. Of a group of equal texts
    (white space aside) the one with the most code points stays, then the smallest id."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = stored(recipes(texts, digest_bytes).withColumn("place", F.monotonically_increasing_id()), "recipes")
    several = stored(_several(texts, found, digest_bytes), "variants")
    identity = ["recipe"]
    if not several.isEmpty():
        by_text = (
            chunk_rows(texts.select("text"), digest_bytes)
            .join(several, ["digest", "chunk"])
            .distinct()
            .groupBy("text_sha256")
            .agg(F.sort_array(F.collect_list(F.struct("seq", "variant"))).alias("variants"))
        )
        found = stored(found.join(by_text, "text_sha256", "left"), "identifiers")
        found = found.withColumn("variants", F.coalesce("variants", F.array().cast("array<struct<seq:int,variant:int>>")))
        identity = ["recipe", "variants"]
    first = F.struct(-F.col("code_points"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("place").alias("at"))
    groups = found.groupBy(*identity).agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("first"))
    groups = stored(groups, "groups")  # joined anew, so that Spark can split the partition of a large group
    return found.join(groups, identity).select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("place") == F.col("first.at")).alias("kept"),
        "text_sha256",
        F.expr(f"length(recipe) div {digest_bytes}").alias("n_chunks"),
    )


def op9_exact_dedup(spark, sf_dir):
    found = exact_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
