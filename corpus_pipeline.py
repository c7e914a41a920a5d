"""From raw documents to token ids: the stages of a training corpus, each on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents (the last one: the tokens). ``run`` applies them in order; what a stage returns is written as Parquet to the
shared folder and read again. A table has no order of its own, so the last stage gives each document its ``position``: read
by it, the tokens follow the mixture.
"""

from __future__ import annotations

from trainlake.llm.common import read, stored
from trainlake.llm.line_chunks import line_dedup_stage
from trainlake.llm.ngram_join import near_duplicate_stage
from trainlake.llm.pfair_mixing import mixing_stage
from trainlake.llm.piece_lattice import sentencepiece_stage
from trainlake.llm.site_quality import quality_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

# The classifier, MinHash and the merges of pieces have no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        found = stage(spark, docs, sf_dir)
        docs = found if number == len(STAGES) else stored(found, f"stage-{number}")
    return docs
