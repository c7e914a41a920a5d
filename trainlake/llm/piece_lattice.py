"""SentencePiece encoding and decoding by a relational lattice.

Texts fall into units: a run of spaces with the word after it, a word at the begin of a line, or a line feed. No piece of
a vocabulary of this kind reaches over the begin of a unit, so the best path of a text is that of its units in order. For
merging, words are also cut where characters meet that no piece holds side by side (``Vocabulary.cut``), such as a word and
its comma. The distinct units of the corpus are counted, their substrings of at most the longest piece's length are exploded
and equi-joined with the piece table (broadcast: its size is that of the vocabulary), the edges are grouped by unit (in the
partitions of the units, the edges are not shuffled), and a fold over the edges of a unit finds its pieces. A character
without a piece becomes its bytes.

``encode_as`` chooses the fold. "bpe" merges, as the library does for a BPE model: the characters of a unit are joined pair
by pair, each time the pair whose piece has the highest score (of equal ones the leftmost), until no pair is a piece.
"unigram" takes the path of the highest sum of scores (Viterbi; of equal scores the longer last piece wins). The query and
the stage fold by the type that the model file states.

Texts are put together from a broadcast of the frequent units (each in at least ``frequent_share`` times as many texts as
there are words) and, for all others, from answers sent to where they are asked for: every text has a bucket by its hash, a
rare unit is counted together with the buckets of its texts, and each task that encodes units sends a bucket one bundle of
all it asked for. Texts and bundles meet by bucket; counting, asking and encoding read the texts once, packing once more.

The scores are those of the model file. A BPE model holds merge ranks as scores: the path of the best rank sum decodes to
the same text, but is not what merging gives, so "unigram" is no encoding of such a model.

Defined cases: null and empty texts have no tokens; a literal U+2581 is a space, as in the library; repeated rows are
encoded one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter, defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from trainlake.llm.common import read, setting, small_batches, spread, stored, text_of, with_place

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT_SHARE = 2e-7
TASK_BYTES = 8_000_000  # of texts, for each bucket and each task of units
TASK_GROUPS = 65536
WORD_BYTES = 6  # about, to tell from the size of the texts how many words there are
UNKNOWN_PENALTY = 10.0  # below the lowest score, as in the library

SHORT = 32  # characters
_NO_RANK = 2**31 - 1

SPACE = "▁"
_UNITS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_WORDS = re.compile(r" +[^ ]*")
_PIECE = "substring(unit, end - len + 1, len)"
_FLUSH_UNITS = 500_000
_FRAME_ROWS = 20_000
_FLUSH_ANSWERS = 1_000_000


class Vocabulary:
    """The pieces of a model file."""

    def __init__(self, model: str = MODEL):
        library = SentencePieceProcessor(model_file=model)
        special = (library.is_control, library.is_unknown, library.is_byte, library.is_unused)
        ids = range(library.get_piece_size())
        stated = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).trainer_spec.model_type
        self.kind = {1: "unigram", 2: "bpe"}.get(stated, "other")
        self.pieces = [(library.id_to_piece(i), i, library.get_score(i)) for i in ids if not any(f(i) for f in special)]
        self.bytes = [0] * 256
        for i in ids:
            if library.is_byte(i):
                self.bytes[int(library.id_to_piece(i)[3:5], 16)] = i
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.unknown = min(s for _, _, s in self.pieces) - UNKNOWN_PENALTY
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p, _, _ in self.pieces):
            raise ValueError("a piece reaches over the begin of a unit")
        self.cut = _cut([p for p, _, _ in self.pieces])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.pieces, "piece string, piece_id int, score double")

    def spelled(self) -> dict[int, bytes]:
        """The bytes of every piece that stands for text."""
        spelled = {i: p.replace(SPACE, " ").encode() for p, i, _ in self.pieces}
        return spelled | {i: bytes([b]) for b, i in enumerate(self.bytes)}


def units(text: str, cut: re.Pattern = _UNITS) -> list[str]:
    return cut.findall(" " + text.replace(SPACE, " ")) if text else []


def words(text: str) -> list[str]:
    """The text cut before every space that follows something else, each part without the first of its spaces. A part with
    this space back is one or several whole units."""
    found = text.replace(SPACE, " ").split(" ") if text else []
    return [w[1:] for w in _WORDS.findall(" " + text.replace(SPACE, " "))] if "" in found else found


def _cut(pieces: list[str]) -> re.Pattern:
    """Units that also end between two kinds of characters: those of the largest group (mostly the letters) that pieces
    connect by holding two side by side, and all others. No piece holds one of each, so nothing is merged over a cut."""
    group: dict[str, set[str]] = {}
    for piece in pieces:
        found = {c for c in piece if c != SPACE}
        joined = set().union(found, *(group[c] for c in found if c in group))
        group.update(dict.fromkeys(joined, joined))
    kind = "".join(map(re.escape, sorted(max(group.values(), key=len, default=set()))))
    return re.compile(f" *[{kind}]+| *[^ \n{kind}]+| +|\n") if kind else _UNITS


def unit_counts(texts: DataFrame, tasks: int, least: int, cut: re.Pattern) -> DataFrame:
    """(unit, n, asks) over all texts (bucket, text), summed within each task first; spaces are written as in pieces. ``n`` is
    the number of texts with the unit, ``asks`` their buckets (see ``_asked``), null from ``least`` on."""
    wide = _wide(tasks)

    def rows(found, many):
        """Frames of the counts; what they have is taken out, so that little is in memory twice."""
        for counts in (found, many):
            while counts:
                some, values = zip(*[counts.popitem() for _ in range(min(len(counts), _FRAME_ROWS))])
                n = [len(codes) // wide for codes in values] if counts is found else values
                asks = pd.Series(values if counts is found else [None] * len(some), dtype=object)
                yield pd.DataFrame({"unit": [u.replace(" ", SPACE) for u in some], "n": n, "asks": asks})

    def count(batches):
        found: dict[str, bytes] = {}
        many: Counter[str] = Counter()
        for batch in batches:
            for bucket, text in zip(batch["bucket"].tolist(), batch["text"]):
                code = bucket.to_bytes(wide, sys.byteorder)
                distinct = set(units(text, cut))
                many.update(often := distinct & many.keys())
                distinct -= often
                again = distinct & found.keys()
                found.update(dict.fromkeys(distinct - again, code))
                for unit in again:
                    codes = found[unit] + code
                    if len(codes) < least * wide:
                        found[unit] = codes
                    else:
                        many[unit] = least
                        del found[unit]
                if len(found) + len(many) >= _FLUSH_UNITS:
                    yield from rows(found, many)
        yield from rows(found, many)

    counted = texts.select("bucket", "text").mapInPandas(count, "unit string, n long, asks binary")
    n = F.sum("n")
    return counted.repartition(tasks, "unit").groupBy("unit").agg(n.alias("n"), F.when(n < least, F.listagg("asks")).alias("asks"))


def _wide(tasks: int) -> int:
    """How many bytes the number of a bucket takes."""
    return 1 if tasks <= 1 << 8 else 2 if tasks <= 1 << 16 else 4


def _asked(asks: bytes, wide: int) -> set[int]:
    return set(memoryview(asks).cast({1: "B", 2: "H", 4: "I"}[wide]))


def _substrings(counted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, n, asks, end, len): the places of the substrings of the units that can be pieces (``_PIECE``)."""
    return counted.withColumn("end", F.explode(F.sequence(F.lit(1), F.length("unit")))).withColumn(
        "len", F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), F.col("end"))))
    )


def merged_together(sizes: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """As ``merged``, for many units of few characters at once, in each round the best pair of every unit. ``places`` has by
    unit, begin and length which of ``ranks`` an edge has, and -1 without an edge: the last rank, which nothing exceeds. The
    result has by unit and begin the end of the piece that begins there, else 0."""
    many, most, longest = places.shape[0], places.shape[1], places.shape[2] - 1
    none, at = ranks[-1], np.arange(most + 1)
    ends = np.where(at < sizes[:, None], at + 1, 0)
    before = np.tile(at - 1, (many, 1))
    pairs, rows = ranks[places[:, :, 2]], np.arange(many)

    def rank(rows, begin, end):
        size = end - begin
        return ranks[places[rows, begin, np.where((size > 0) & (size <= longest), size, 0)]]

    while len(rows):
        begin = pairs.argmin(axis=1)  # of equal ones the leftmost
        left = pairs[np.arange(len(rows)), begin] < none
        if not left.all():
            pairs, rows, begin = pairs[left], rows[left], begin[left]
        own, middle = np.arange(len(rows)), ends[rows, begin]
        end = ends[rows, middle]
        ends[rows, begin], ends[rows, middle], before[rows, end] = end, 0, begin
        pairs[own, middle] = none
        pairs[own, begin] = rank(rows, begin, ends[rows, end])
        first = before[rows, begin]
        own, rows_of, end, first = (x[first >= 0] for x in (own, rows, end, first))
        pairs[own, first] = rank(rows_of, first, end)
    return ends[:, :most]


def merged_short(size: int, edges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``merged_together`` for one unit."""
    spans = list(edges)
    places = np.full((1, size, max([2, *(b - a for a, b in spans)]) + 1), -1)
    for place, (begin, end) in enumerate(spans):
        places[0, begin, end - begin] = place
    ends = merged_together(np.array([size]), places, np.array([*(edges[s][0] for s in spans), _NO_RANK]))
    return [*np.flatnonzero(ends[0]).tolist(), size]


def merged(size: int, edges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Where the pieces of a unit of ``size`` characters begin, and its end, when the pair of neighbours of the lowest rank
    (then the leftmost) is joined as long as there is one. ``edges`` has (rank, id) by (begin, end)."""
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    open_pairs = [(edge[0], i, i + 2) for i in range(size - 1) if (edge := edges.get((i, i + 2)))]
    heapify(open_pairs)
    ends = {i: i + 1 for i in range(size)}  # of the symbols that there are now
    while open_pairs:
        _, begin, end = heappop(open_pairs)
        middle = ends.get(begin)
        if middle is None or middle >= end or ends.get(middle) != end:
            continue  # one of the two has been joined with another since
        del ends[middle]
        ends[begin] = after[begin] = end
        if end < size:
            before[end] = begin
            if edge := edges.get((begin, after[end])):
                heappush(open_pairs, (edge[0], begin, after[end]))
        if begin and (edge := edges.get((before[begin], end))):
            heappush(open_pairs, (edge[0], before[begin], end))
    return [*sorted(ends), size]


def merged_units(counted: DataFrame, vocabulary: Vocabulary):
    """The edges of every unit, and the fold of their batches to batches of (unit, n, asks, ids), merged by rank."""
    spark = counted.sparkSession
    by_score = {s: rank for rank, s in enumerate(sorted({s for _, _, s in vocabulary.pieces}, reverse=True))}
    places = [(piece, place) for place, (piece, _, _) in enumerate(vocabulary.pieces)]
    ranks = np.array([*(by_score[s] for _, _, s in vocabulary.pieces), _NO_RANK])
    piece_ids = np.array([*(i for _, i, _ in vocabulary.pieces), -1], dtype=np.int32)
    byte_ids, stride, width = vocabulary.bytes, len(places), vocabulary.longest + 1
    # Joined by hash, a number, and then compared: a join by the strings themselves takes more than twice the time.
    pieces = F.broadcast(spark.createDataFrame(places, "known string, place long").withColumn("hash", F.xxhash64("known")))
    # An edge is one number: its end, its length and the place of its piece.
    edges = (
        _substrings(counted, vocabulary).withColumn("hash", F.expr(f"xxhash64({_PIECE})")).join(pieces, "hash", "left")
        .where(f"known = {_PIECE} OR len = 1")
        .selectExpr("unit", "n", "asks", f"if(known = {_PIECE}, (cast(end AS long) * {width} + len) * {stride} + place, null) AS edge")
    )
    lattice = edges.groupBy("unit").agg(F.first("n").alias("n"), F.first("asks").alias("asks"), F.collect_list("edge").alias("edges"))

    def spelled_out(unit, cuts, edges):
        """The pieces between the cuts, by their spans; what has no piece is one character."""
        spans = zip(cuts, cuts[1:])
        return [i for a, b in spans for i in ([edges[a, b]] if (a, b) in edges else [byte_ids[x] for x in unit[a:b].encode()])]

    def fold(batches):
        for batch in batches:
            units, n = batch["unit"].tolist(), len(batch)
            sizes = np.fromiter(map(len, units), np.int64, n)
            row = np.repeat(np.arange(n), np.fromiter(map(len, batch["edges"]), np.int64, n))
            spans, place = np.divmod(np.concatenate([*batch["edges"], np.empty(0, np.int64)]), stride)
            end, size = np.divmod(spans, width)
            short = np.flatnonzero(sizes <= SHORT)
            lattices = np.full((n, max([1, *sizes[short]]), max(width, 3)), -1, dtype=np.int32)
            own = sizes[row] <= SHORT
            lattices[row[own], (end - size)[own], size[own]] = place[own]
            ends = merged_together(np.where(sizes <= SHORT, sizes, 0), lattices, ranks)
            of, begin = np.nonzero(ends)
            ids = piece_ids[lattices[of, begin, ends[of, begin] - begin]]
            limits = np.searchsorted(of, np.arange(n + 1)).tolist()
            found = [ids[a:b] for a, b in zip(limits, limits[1:])]
            # units with characters without a piece, and long ones
            for i in np.union1d(of[ids < 0], np.flatnonzero(sizes > SHORT)).tolist():
                first, last = np.searchsorted(row, [i, i + 1])
                keys = list(zip((end - size)[first:last].tolist(), end[first:last].tolist()))
                if sizes[i] > SHORT:
                    cuts = merged(len(units[i]), dict(zip(keys, zip(ranks[place[first:last]].tolist()))))
                else:
                    cuts = [*begin[limits[i] : limits[i + 1]].tolist(), len(units[i])]
                found[i] = spelled_out(units[i], cuts, dict(zip(keys, piece_ids[place[first:last]].tolist())))
            yield pd.DataFrame({"unit": units, "n": batch["n"], "asks": batch["asks"], "ids": pd.Series(found, dtype=object)})

    return lattice, fold


def encoded_units(counted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, n, asks, ids) for every row (unit, n, asks), by the path of the highest sum of scores."""
    pieces = F.broadcast(vocabulary.table(counted.sparkSession))
    edges = (
        _substrings(counted, vocabulary).withColumn("piece", F.expr(_PIECE)).join(pieces, "piece", "left")
        .where("piece_id IS NOT NULL OR len = 1")
        .select(
            "unit", "n", "asks",
            F.struct(
                "end", "len", F.coalesce("piece_id", F.lit(-1)).alias("id"),
                F.coalesce("score", F.lit(vocabulary.unknown)).alias("score"),
            ).alias("edge"),
        )
    )
    lattice = edges.groupBy("unit").agg(
        F.first("n").alias("n"), F.first("asks").alias("asks"), F.sort_array(F.collect_list("edge")).alias("edges")
    )
    # best[e] is the best path that ends after character e; edges come by end, so only the last entry can still change
    best = F.expr("""
        aggregate(edges, array(struct(0D AS score, 0 AS len, -1 AS id)), (best, e) ->
            if(size(best) = e.end,
               concat(best, array(struct(best[e.end - e.len].score + e.score AS score, e.len AS len, e.id AS id))),
               if(best[e.end - e.len].score + e.score >= best[e.end].score,
                  concat(slice(best, 1, e.end), array(struct(best[e.end - e.len].score + e.score AS score, e.len AS len, e.id AS id))),
                  best)))
    """)
    # from the last character back; a character without a piece is written as -1 - its place
    path = F.expr("""
        reverse(aggregate(sequence(1, size(best) - 1), struct(size(best) - 1 AS at, cast(array() AS array<int>) AS path),
            (s, i) -> if(s.at = 0, s, struct(
                s.at - best[s.at].len AS at,
                concat(s.path, array(if(best[s.at].id >= 0, best[s.at].id, -s.at))) AS path)),
            s -> s.path))
    """)
    byte_ids = "array(" + ",".join(map(str, vocabulary.bytes)) + ")"
    ids = F.expr(f"""
        if(forall(path, p -> p >= 0), path, flatten(transform(path, p -> if(p >= 0, array(p),
            transform(sequence(1, length(hex(encode(substring(unit, -p, 1), 'UTF-8'))) div 2),
                k -> element_at({byte_ids}, cast(conv(substring(hex(encode(substring(unit, -p, 1), 'UTF-8')), 2 * k - 1, 2), 16, 10) AS int) + 1))))))
    """)
    return lattice.withColumn("best", best).withColumn("path", path).select("unit", "n", "asks", ids.alias("ids"))


def _bundle(answers: list[tuple[str, bytes]]) -> bytes:
    """Units and their ids; a line feed parts the units, and the unit that is one is written as nothing."""
    names = "\n".join("" if unit == "\n" else unit for unit, _ in answers).replace(SPACE, " ").encode()
    sizes = np.array([len(names), len(answers), *(len(ids) for _, ids in answers)], dtype=np.int32).tobytes()
    return b"".join([sizes, names, *(ids for _, ids in answers)])


def _opened(whole: bytes) -> dict[str, bytes]:
    length, n = np.frombuffer(whole, dtype=np.int32, count=2).tolist()
    first = 8 + 4 * n
    ends = (np.cumsum(np.frombuffer(whole, dtype=np.int32, count=n, offset=8)) + first + length).tolist()
    names = whole[first : first + length].decode().split("\n")
    return {u or "\n": whole[a:b] for u, a, b in zip(names, [first + length, *ends], ends)}


def answered(batches, least: int, wide: int):
    """(bucket, n, unit, packed): the frequent units of batches (unit, n, asks, ids) one by one, and all that a bucket has asked
    for together, without n and unit."""
    columns = ["bucket", "n", "unit", "packed"]
    held: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
    size, packer = 0, zstandard.ZstdCompressor()

    def bundles():
        found = [(bucket, None, None, packer.compress(_bundle(answers))) for bucket, answers in held.items()]
        if found:
            yield pd.DataFrame(found, columns=columns).astype({"n": "Int64"})

    for batch in batches:
        frequent = []
        for unit, n, asks, ids in zip(batch["unit"], batch["n"].tolist(), batch["asks"], batch["ids"]):
            packed = np.asarray(ids, dtype=np.int32).tobytes()
            if n >= least:
                frequent.append((-1, n, unit, packed))
                continue
            answer = (unit, packed)
            for bucket in _asked(asks, wide):
                held[bucket].append(answer)
                size += 1
        if frequent:
            yield pd.DataFrame(frequent, columns=columns)
        if size >= _FLUSH_ANSWERS:
            yield from bundles()
            held.clear()
            size = 0
    yield from bundles()


def encode(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", frequent_share: float = FREQUENT_SHARE,
    with_text: bool = True, place_col: str | None = None, encode_as: str = "unigram",
) -> DataFrame:
    """(doc_id, text, ids, round_trip): the pieces of every text in order, and whether they decode to it. Without
    ``with_text`` the text stays null and is not moved again. ``place_col``, a whole number, is kept as ``position``."""
    spark = docs.sparkSession
    small_batches(spark)
    if encode_as not in ("unigram", "bpe"):
        raise ValueError("only unigram and BPE models are encoded")
    place = F.col(place_col).cast("long") if place_col else F.lit(None).cast("long")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), place.alias("position"))
    size, rows = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    least = max(2, math.ceil(((size or 0) // WORD_BYTES + rows) * frequent_share))
    tasks = spread((size or 0) + 32 * rows, TASK_BYTES)
    texts = texts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "position", "text"), F.lit(tasks)).cast("int"))
    wide, cut = _wide(tasks), vocabulary.cut if encode_as == "bpe" else _UNITS

    counted = unit_counts(texts, tasks, least, cut)
    if encode_as == "bpe":
        lattice, fold = merged_units(counted, vocabulary)
    else:
        lattice, fold = encoded_units(counted, vocabulary), iter
    answers = lattice.mapInPandas(lambda batches: answered(fold(batches), least, wide), "bucket int, n long, unit string, packed binary")
    # A task groups its units by hashing, without the sort of all edges that Spark turns to from 128 groups.
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(TASK_GROUPS)):
        answers = stored(answers, "units")
    common = answers.where("n IS NOT NULL").orderBy("n", "unit").select("unit", "packed")
    known = {r["unit"].replace(SPACE, " "): bytes(r["packed"]) for r in common.toLocalIterator()}
    # texts are moved compressed; the frequent units are what they have in common
    prefix = "".join(known).encode()[-65536:]
    shared = spark.sparkContext.broadcast((known, prefix, vocabulary.spelled()))

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared.value[1], dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        for batch in batches:
            packed = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"]]
            yield pd.DataFrame({"bucket": batch["bucket"], "is_text": True, "doc_id": batch["doc_id"], "position": batch["position"], "packed": packed})

    def put_together(batches):
        known, prefix, pieces = shared.value
        pieces = _by_id(pieces)
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(prefix, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        at, ids_of = None, known
        for batch in batches:
            texts, found, same = [], [], []
            for bucket, is_text, packed in zip(*(batch[c].to_pylist() for c in ("bucket", "is_text", "packed"))):
                if bucket != at:
                    at, ids_of = bucket, known.copy()
                if not is_text:  # come first in their bucket
                    ids_of.update(_opened(zstandard.decompress(packed)))
                    continue
                text = opener.decompress(packed).decode("utf-8", "surrogatepass")
                ids = b"".join(map(ids_of.__getitem__, units(text, cut)))
                texts.append(text if with_text else None)
                found.append(ids)
                same.append(spelled(np.frombuffer(ids, dtype=np.int32), pieces) == text.replace(SPACE, " "))
            if found:
                # As Arrow's own lists: pandas would have every id made an object.
                limits = np.cumsum([0, *(len(ids) // 4 for ids in found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(limits), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
                kept = batch.filter(batch["is_text"])
                columns = [kept["doc_id"], kept["position"], pa.array(texts, pa.string()), lists, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "text", "ids", "round_trip"])

    moved = "bucket int, is_text boolean, doc_id long, position long, packed binary"
    packed = texts.mapInPandas(pack, moved)
    bundles = answers.where("n IS NULL").selectExpr("bucket", "false AS is_text", "0L AS doc_id", "0L AS position", "packed")
    both = bundles.unionByName(packed).repartitionById(tasks, "bucket").sortWithinPartitions("bucket", "is_text")
    found = both.mapInArrow(put_together, "doc_id long, position long, text string, ids array<int>, round_trip boolean")
    return found if place_col else found.drop("position")


def _by_id(pieces: dict[int, bytes]) -> np.ndarray:
    """The bytes of the pieces, each in the place of its id."""
    found = np.full(max(pieces) + 1, b"", dtype=object)
    found[list(pieces)] = list(pieces.values())
    return found


def spelled(ids: np.ndarray, pieces: np.ndarray) -> str:
    """The text of a list of pieces, without the space that encoding puts before it."""
    text = b"".join(pieces[ids].tolist()).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``; null ids give null. Ids that stand for no text (controls, unknown, out of range) add nothing."""
    pieces = rows.sparkSession.sparkContext.broadcast(vocabulary.spelled())

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        known = pieces.value
        by_id = _by_id(known)
        return lists.map(lambda x: None if x is None else spelled(np.array([i for i in x if i in known], dtype=np.int64), by_id))

    return rows.withColumn("decoded", text(ids_col))


def _tokens(docs: DataFrame, model: str, place_col: str | None = None) -> DataFrame:
    vocabulary = Vocabulary(model)
    found = encode(docs, vocabulary, with_text=False, place_col=place_col, encode_as=vocabulary.kind)
    place = ["position"] if place_col else []
    return found.select("doc_id", *place, F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")


def op6_sentencepiece(spark, sf_dir):
    return _tokens(read(spark, sf_dir, "documents"), MODEL)


def sentencepiece_stage(spark, docs, sf_dir):
    """The pieces of every document, and its ``position`` in the order in which the stage before wrote the documents."""
    return _tokens(with_place(docs.select("doc_id", "text"), "place"), MODEL, "place")
