"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines is computed for every gap between lines; a gap whose hash is
lower than those of the gaps beside it ends a chunk. The rule looks at four lines around a gap and at nothing else, so
lines put in front of a passage do not shift its chunks. A line of at least ``long_words`` words is a chunk of its own.
Chunks of several lines, and long lines, that occur more than once in the corpus are removed except for their first
occurrence (smallest id, then place). Chunks are grouped by hash and bytes, so different texts of equal hash stay apart.

Chunks have edges: of a passage that stands on a few short lines, chunks mostly mix its lines with their neighbours. With
``runs`` the result does not depend on where chunks end: the shortest run of lines from every line on, and up to every line,
that reaches ``long_words`` words is looked up in the whole corpus as well (of a text of fewer words on several lines, the
whole text), and the lines of a run go but at its first place. Every line of a repeated passage of whole lines with that
many words lies in such a run inside the passage, so the passage goes as a whole, and so does an exact copy of a text. Runs
are equal if their digests of 128 bits (BLAKE2b over those of the lines) are.

Defined cases: null text counts as empty and stays null where nothing is removed; a null id is larger than any other;
rows equal in id and text are one document and treated alike; chunks of white space only are never removed; an empty
table gives no rows; other columns, also of clashing names, are kept by the stage.
"""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import read, small_batches, some, stored, text_of

LONG_WORDS = 50


def _marked(rows: DataFrame, long_words: int) -> DataFrame:
    """Add lines, and starts and ends of the chunks of each text. ``body`` is the text."""
    return (
        rows.withColumn("lines", F.split("body", "\n", -1))
        .withColumn("n", F.size("lines"))
        .withColumn("hashes", F.expr("transform(lines, x -> md5(x))"))
        .withColumn("gaps", F.expr("if(n > 1, transform(sequence(0, n - 2), i -> md5(concat(hashes[i], hashes[i + 1]))), array())"))
        .withColumn("long", F.expr(f"transform(lines, x -> length(x) - length(replace(x, ' ', '')) >= {long_words - 1})"))
        .withColumn("cuts", F.expr(
            "if(n > 1, filter(sequence(1, n - 1), k -> long[k - 1] OR long[k]"
            " OR (coalesce(gaps[k - 1] < get(gaps, k - 2), true) AND coalesce(gaps[k - 1] <= get(gaps, k), true))), array())"
        ))
        .withColumn("starts", F.expr("concat(array(0), cuts)"))
        .withColumn("ends", F.expr("concat(cuts, array(n))"))
        .drop("hashes", "gaps", "cuts", "n")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, row: bool = False) -> DataFrame:
    kept = [F.struct(F.col("*")).alias("row")] if row else []
    return docs.select(
        F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text_of(text_col)).alias("print"), text_of(text_col).alias("body"), *kept,
    )


def _chunks(rows: DataFrame, long_words: int, bits: int) -> DataFrame:
    """(no_id, id, print, pos, chunk) of the chunks that may be removed."""
    parts = F.expr(
        "zip_with(starts, ends, (a, b) -> if(b - a > 1 OR long[a], array_join(slice(lines, a + 1, b - a), '\\n'), null))"
    )
    exploded = _marked(rows, long_words).select("no_id", "id", "print", F.posexplode(parts).alias("pos", "chunk"))
    return exploded.where("chunk IS NOT NULL AND trim(BOTH ' \\t\\r\\n' FROM chunk) <> ''").withColumn("hash", F.shiftright(F.xxhash64("chunk"), 64 - bits))


def removals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS, bits: int = 64
) -> DataFrame:
    """(no_id, id, print, removed): the places of the chunks to be removed, for each text that has any. ``bits`` of the hash
    decide how often the bytes must tell chunks of equal hash apart."""
    found = _chunks(_keyed(docs, id_col, text_col), long_words, bits)
    at = F.struct("no_id", "id", "print", "pos")
    compared = found.groupBy("hash", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
    compared = stored(compared.drop("chunk"), "line-chunks")
    by_hash = compared.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.max("first").alias("first"))
    repeated = stored(by_hash.where("n > 1"), "repeated-chunks")
    sure = repeated.where("texts = 1").select("hash", "first")
    occurrences = found.select("no_id", "id", "print", "pos", "hash")
    later = at != F.col("first")
    gone = occurrences.join(sure, "hash").where(later).select("no_id", "id", "print", "pos")
    clashes = repeated.where("texts > 1").select("hash")
    if not clashes.isEmpty():  # one hash for several texts: compared by text
        few = found.join(clashes, "hash", "left_semi")
        firsts = few.groupBy("hash", "chunk").agg(F.min(at).alias("first"))
        gone = gone.unionByName(few.join(firsts, ["hash", "chunk"]).where(later).select("no_id", "id", "print", "pos"))
    return gone.groupBy("no_id", "id", "print").agg(F.collect_set("pos").alias("removed"))


def shortest_runs(counts: list[int], words: int) -> set[tuple[int, int]]:
    """(begin, end) of the shortest runs of lines with at least so many words, from every line on and up to every line.
    A text of several lines that has fewer words is one run."""
    n, found = len(counts), set()
    if sum(counts) < words:
        return {(0, n)} if n > 1 and any(counts) else found
    end = have = 0
    for begin in range(n):
        while have < words and end < n:
            have += counts[end]
            end += 1
        if have < words:
            break
        found.add((begin, end))
        have -= counts[begin]
    begin = have = 0
    for last in range(n):
        have += counts[last]
        while have - counts[begin] >= words:
            have -= counts[begin]
            begin += 1
        if have >= words:
            found.add((begin, last + 1))
    return found


def run_removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS) -> DataFrame:
    """(no_id, id, print, spans): the lines [begin, end) that stand in runs with an earlier place, for each text that has any."""
    small_batches(docs.sparkSession)
    names = ["no_id", "id", "print", "begin", "end", "h1", "h2"]

    def find(batches):
        for batch in batches:
            rows = []
            for *key, body in zip(batch["no_id"], batch["id"], batch["print"], batch["body"]):
                lines = body.split("\n")
                digests = b"".join([blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines])
                for begin, end in shortest_runs([len(x.split()) for x in lines], long_words):
                    digest = blake2b(digests[16 * begin : 16 * end], digest_size=16).digest()
                    halves = (int.from_bytes(digest[i : i + 8], "big", signed=True) for i in (0, 8))
                    rows.append((*key, begin, end, *halves))
            yield from some(rows, names)

    found = _keyed(docs, id_col, text_col).mapInPandas(find, "no_id boolean, id long, print long, begin int, end int, h1 long, h2 long")
    at = F.struct("no_id", "id", "print", "begin", "end")
    counted = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
    firsts = stored(counted.where("n > 1").drop("n"), "repeated-runs")
    # a run that overlaps its own first place leaves that in place
    same = (F.col("no_id") == F.col("first.no_id")) & (F.col("id") == F.col("first.id")) & (F.col("print") == F.col("first.print"))
    later = found.join(firsts.hint("merge"), ["h1", "h2"]).where(at != F.col("first"))
    cut = later.withColumn("begin", F.when(same, F.greatest("begin", "first.end")).otherwise(F.col("begin"))).where("begin < end")
    return cut.groupBy("no_id", "id", "print").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS, bits: int = 64, runs: bool = False
) -> DataFrame:
    """(row, text, chunks, removed): every row of ``docs`` with its text without the repeated chunks, how many chunks it
    had and how many went. With ``runs`` the lines of repeated runs go, too, and ``removed`` counts lines."""
    gone = removals(docs, id_col, text_col, long_words, bits)
    if runs:
        both = gone.unionByName(run_removals(docs, id_col, text_col, long_words), allowMissingColumns=True)
        gone = both.groupBy("no_id", "id", "print").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("removed", "spans")])
    gone = stored(gone, "removals")
    # A merge join at every size: the removals grow with the corpus. The text moves once, within its row.
    joined = _keyed(docs, id_col, text_col, row=True).drop("body").join(gone.hint("merge"), ["no_id", "id", "print"], "left")
    rows = _marked(joined.withColumn("body", F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))), long_words)
    if runs:
        rows = rows.withColumn("removed", F.expr(
            "if(removed IS NULL AND spans IS NULL, null, array_distinct(concat("
            " flatten(transform(coalesce(removed, array()), k -> sequence(starts[k], ends[k] - 1))),"
            " flatten(transform(coalesce(spans, array()), s -> sequence(s.begin, s.end - 1))))))"
        ))
    n_removed = F.coalesce(F.size("removed"), F.lit(0))
    kept = F.expr(
        "array_join(transform(array_except(sequence(0, size(starts) - 1), removed),"
        " k -> array_join(slice(lines, starts[k] + 1, ends[k] - starts[k]), '\\n')), '\\n')"
    )
    if runs:
        kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), removed), i -> lines[i]), '\n')")
    text = F.when(F.col("removed").isNotNull(), kept).otherwise(F.col(f"row.`{text_col}`"))
    done = F.struct(
        text.alias("text"), F.size("starts").alias("chunks"), F.when(F.col("removed").isNull(), 0).otherwise(n_removed).alias("removed"),
    )
    # Exploding one struct keeps later filters on the text above it: pushed below, they would cut the text anew per line.
    return rows.select("row", F.explode(F.array(done)).alias("done")).select("row", "done.*")


def op4_line_dedup(spark, sf_dir):
    found = without_repeats(read(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return found.select(
        "row.doc_id", F.col("chunks").cast("long").alias("chunks"), F.col("removed").cast("long").alias("removed"),
        F.length(text).cast("long").alias("n_left"), F.md5(text).alias("text_md5"),
    )


def line_dedup_stage(spark, docs, sf_dir):
    """The documents with their texts cleaned of repeated chunks and runs, and n_chars to match; a document of which nothing but white space is left
    goes, one that had no text before stays."""
    found = without_repeats(docs, runs=True)
    left = found.where("removed = 0 OR trim(BOTH ' \\t\\r\\n' FROM text) <> ''")
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = F.when(F.col("removed") > 0, row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))).otherwise(row)
    return left.select(row.alias("row")).select("row.*")
