"""Phrase collocations by Rabin-Karp fingerprints.

Texts (A-Z in lower case) are split at `[.,;:!?\\x0A-\\x0D]` into pieces and these at spaces and tabs into words. Everything counts per language.
For a phrase of 2 to `LONGEST` words that occurs a >= `LEAST` times, each cut into a first part and a rest, which occur l and r times, gives
floor(1000 a n / (l r)), n being all word occurrences; the lowest of them is the score.

1. Prefix polynomials over bytes hash every word, prefix polynomials over word hashes every n-gram: two subtractions each, in numpy.
2. Units of documents ask what their distinct fingerprints count in all units. A question is (fingerprint, count), its occurrence pointer is the
   unit and its place in the unit's ascending list; the answer for that place is one bit, frequent or not. Orders are asked in the rounds
   `ROUNDS`: an n-gram is asked for only if all its parts that were asked before are frequent, as it cannot be more frequent than a part of it.
   So a phrase costs one entry a unit, however frequent it is, and fingerprints that collide can only let too many through.
3. Where the answers point at a frequent n-gram, its unit counts its occurrences by their words (equal fingerprints with other words are told
   apart) and gives out the text, one packed table for each shard of fingerprints. These are merged by text, parts of `MERGED` units first: the
   sums over equal texts are the exact counts, and only those of `LEAST` or more stay. So each phrase becomes one row once it is summed.
4. Cuts, parts inside longer phrases and ranks are joins, aggregates and one sort by range. Products are decimals: a and n may reach 10^17.

Null text: empty. Null language: `und`. Empty texts, and texts of separators alone, count nothing. Null or repeated doc_ids play no part, repeated rows count
each. Ties in score and a go to the smaller phrase in UTF-8 byte order. An empty table gives an empty result. Only text and lang are
read, other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotledger.llm.tables import ship, stored, texts_of
from lotledger.llm.units import in_units, packed, planes, rows_of, unpacked, unplanes
from lotledger.llm.words import lowered, mixed, raw, span_hashes, window_hashes, word_spans

ship(__name__)

LONGEST, LEAST, TOP, UNKNOWN = 5, 100, 2000, "und"
ROUNDS = ((1, 2), (3,), (4, 5))
ROUND_OF = {size: k for k, sizes in enumerate(ROUNDS) for size in sizes}
UNIT_BYTES, SHARD_WORDS, MERGED = 4 << 20, 1 << 21, 1024
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
QUESTION = "shard int, unit long, size int, keys binary, counts binary"
ANSWER = "unit long, size int, shard int, bits binary"


class Grams:
    """The words of a unit's documents and the fingerprints of their n-grams."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        data, offsets = raw(texts_of(rows))
        data = lowered(data)
        cut = np.isin(data, np.frombuffer(SEPARATORS, np.uint8))
        self.data = np.where(cut, np.uint8(32), data)
        self.starts, self.ends, self.counts = word_spans(self.data, offsets)
        self.words = span_hashes(self.data, self.starts, self.ends)
        self.langs = pc.dictionary_encode(pc.fill_null(rows.column("lang"), UNKNOWN))
        names = self.langs.dictionary
        edges = raw(names)[1]
        salts = span_hashes(raw(names)[0], edges[:-1], edges[1:])
        own = np.repeat(self.langs.indices.to_numpy(), self.counts)
        self.lang, self.salt = own, salts[own]
        # Pieces are numbered through all documents: each separator and each document begins a new one.
        self.piece = np.cumsum(cut)[self.starts] + np.repeat(np.arange(len(self.counts)), self.counts)

    def fingerprints(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first word of every n-gram that lies in one piece."""
        hashes, first, _ = window_hashes(self.words, np.array([len(self.words)]), size)
        inside = self.piece[first] == self.piece[first + size - 1]
        first = first[inside]
        return mixed(hashes[inside] ^ self.salt[first]), first


def _shards(ascending: np.ndarray, shard_bits: int) -> Iterator[tuple[int, int, int]]:
    """Shard, and where it begins and ends among ascending fingerprints; empty shards are left out."""
    number = ascending >> np.uint64(64 - shard_bits) if shard_bits else np.zeros(len(ascending), np.uint64)
    edges = np.flatnonzero(np.diff(number)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)], strict=True):
        if b > a:
            yield int(number[a]), a, b


class Known:
    """What a unit's n-grams are after some rounds: for each order the frequent fingerprints and where they begin."""

    def __init__(self, grams: Grams, answers: pa.Table | None, shard_bits: int) -> None:
        self.grams, self.shard_bits = grams, shard_bits
        self.flags: dict[tuple[int, int], bytes] = {}
        if answers is not None:
            told = (answers.column(c).to_pylist() for c in ("size", "shard", "bits"))
            self.flags = {(size, shard): bits for size, shard, bits in zip(*told, strict=True)}
        self.asked = sorted({size for size, _ in self.flags})
        self.frequent: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.begins: dict[int, np.ndarray] = {}
        for size in self.asked:
            keys, first, places, _ = self.candidates(size)
            yes = np.zeros(len(places), bool)
            for shard, a, b in _shards(keys[places], shard_bits):
                yes[a:b] = np.unpackbits(np.frombuffer(self.flags[size, shard], np.uint8), count=b - a)
            of_each = np.repeat(yes, np.diff(np.append(places, len(keys))))
            self.frequent[size] = keys[of_each], first[of_each]
            begins = np.zeros(len(grams.words) + 1, bool)
            begins[first[of_each]] = True
            self.begins[size] = begins

    def candidates(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ascending fingerprints whose known parts are all frequent, their first words, where each distinct one begins, and its count."""
        keys, first = self.grams.fingerprints(size)
        parts = [n for n in self.begins if ROUND_OF[n] < ROUND_OF[size]]
        if parts:
            part = max(parts)
            may = np.ones(len(first), bool)
            for k in range(size - part + 1):
                may &= self.begins[part][first + k]
            keys, first = keys[may], first[may]
        order = np.argsort(keys, kind="stable")
        keys, first = keys[order], first[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        places = np.flatnonzero(new)
        return keys, first, places, np.diff(np.append(places, len(keys)))


def _asked(sizes: tuple[int, ...], shard_bits: int) -> Callable:
    schema = pa.schema([("shard", pa.int32()), ("unit", pa.int64()), ("size", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(rows: pa.RecordBatch, unit: int, answers: pa.Table | None) -> pa.Table:
        known = Known(Grams(rows), answers, shard_bits)
        out = []
        for size in sizes:
            keys, _, places, counts = known.candidates(size)
            distinct = keys[places]
            few = np.minimum(counts, LEAST).astype(np.uint16)
            for shard, a, b in _shards(distinct, shard_bits):
                out.append((shard, unit, size, packed(distinct[a:b]), planes(few[a:b])))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _first_round(ask: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from ask(rows_of(batch, k), batch.column("unit")[k].as_py(), None).to_batches()

    return run


def _later_round(ask: Callable) -> Callable:
    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.concat_tables([ask(rows_of(units, k), units.column("unit")[k].as_py(), answers) for k in range(units.num_rows)])

    return run


ANSWERS = pa.schema([("unit", pa.int64()), ("size", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())])


def _counted(group: pa.Table) -> pa.Table:
    """The counts of one shard and order added up; for each unit, which of its fingerprints are frequent. Counts stop at `LEAST`."""
    own = [unpacked(x.as_py()) for x in group.column("keys")]
    sizes = [len(x) for x in own]
    keys = np.concatenate(own)
    counts = np.concatenate([unplanes(x.as_py(), np.uint16) for x in group.column("counts")])
    order = np.argsort(keys, kind="stable")
    ascending = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
    yes = np.empty(len(keys), bool)
    yes[order] = (sums >= LEAST)[np.cumsum(new) - 1]
    bits = [np.packbits(x).tobytes() for x in np.split(yes, np.cumsum(sizes)[:-1])]
    return pa.table([group.column("unit"), group.column("size"), group.column("shard"), pa.array(bits, pa.binary())], schema=ANSWERS)


PHRASES = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())])


def _exact_ids(grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal only where the bytes are, and the place of one occurrence of each number."""
    _, places, ids = np.unique(grams.words, return_index=True, return_inverse=True)
    length = grams.ends - grams.starts
    like = places[ids]
    same = length == length[like]
    at = np.repeat(grams.starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    other = at + np.repeat(grams.starts[like] - grams.starts, length)
    if same.all() and (grams.data[at] == grams.data[other]).all():
        return ids, places
    words: dict[bytes, int] = {}
    own = [grams.data[a:b].tobytes() for a, b in zip(grams.starts.tolist(), grams.ends.tolist(), strict=True)]
    ids = np.array([words.setdefault(w, len(words)) for w in own], np.int64)
    return ids, np.unique(ids, return_index=True)[1]


def _blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unblob(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


TOLD = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("told", pa.binary())])


def _told(shard_bits: int, parts: int) -> Callable:
    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        """For each shard the frequent n-grams of a unit as a packed table: lang, size, phrase and count in the unit. size 0: all words of a language."""
        out = []
        for k in range(units.num_rows):
            grams = Grams(rows_of(units, k))
            part = units.column("unit")[k].as_py() % parts
            names = grams.langs.dictionary
            many = np.bincount(grams.lang, minlength=len(names))
            own = {0: [pa.table([names, pa.array(np.zeros(len(names)), pa.int32()), pa.nulls(len(names), pa.string()), pa.array(many, pa.int64())], schema=PHRASES)]}
            known = Known(grams, answers, shard_bits) if len(grams.words) else None
            ids, places = _exact_ids(grams) if known else (None, None)
            vocabulary: dict[int, str] = {}

            def word(i: int, grams: Grams = grams, places: np.ndarray = places, vocabulary: dict = vocabulary) -> str:
                if i not in vocabulary:
                    vocabulary[i] = grams.data[grams.starts[places[i]] : grams.ends[places[i]]].tobytes().decode()
                return vocabulary[i]

            for size, (keys, first) in known.frequent.items() if known else ():
                columns = [grams.lang[first], *(ids[first + j] for j in range(size))]
                new = np.ones(len(first), bool)
                new[1:] = keys[1:] != keys[:-1]
                differ = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
                if (differ & ~new[1:]).any():  # one fingerprint of several phrases
                    order = np.lexsort([*columns, keys])
                    first, columns = first[order], [c[order] for c in columns]
                    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
                begin = np.flatnonzero(new)
                phrases = [" ".join(map(word, row)) for row in np.stack([c[begin] for c in columns[1:]], 1).tolist()]
                counts = np.diff(np.append(begin, len(first)))
                table = pa.table([
                    names.take(pa.array(columns[0][begin])), pa.array(np.full(len(begin), size), pa.int32()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64()),
                ], schema=PHRASES)
                for shard, a, b in _shards(keys[begin], shard_bits):
                    own.setdefault(shard, []).append(table.slice(a, b - a))
            out += [(shard, part, _blob(pa.concat_tables(tables))) for shard, tables in own.items()]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(TOLD)], schema=TOLD)

    return run


def _summed(group: pa.Table) -> pa.Table:
    """The counts of equal phrases added up, some packed tables at a time."""
    kept, waiting = None, []
    for k, told in enumerate(group.column("told"), 1):
        waiting.append(_unblob(told.as_py()))
        if k % 64 == 0 or k == group.num_rows:
            kept = pa.concat_tables([*waiting, *([] if kept is None else [kept])]).group_by(["lang", "size", "phrase"]).aggregate([("a", "sum")])
            kept, waiting = kept.rename_columns(["lang", "size", "phrase", "a"]).select(PHRASES.names), []
    return kept


def _merged(group: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([group.column("shard").slice(0, 1), group.column("part").slice(0, 1), pa.array([_blob(_summed(group))], pa.binary())], schema=TOLD)


def _final(group: pa.Table) -> pa.Table:
    """The phrases of one shard that are frequent by their texts, and the words of each language."""
    sums = _summed(group)
    return sums.filter(pc.or_(pc.equal(sums.column("size"), 0), pc.greater_equal(sums.column("a"), LEAST)))


def frequent(docs: DataFrame) -> DataFrame:
    """lang, size, phrase, a: exact counts of all phrases of up to `LONGEST` words that occur `LEAST` times; of size 0 all words of a language."""
    units = in_units(docs.select("text", F.col("lang").cast("string").alias("lang")), UNIT_BYTES)
    total, n = units.agg(F.sum("n_words"), F.count("*")).first()
    shard_bits = max(0, ((total or 0) // SHARD_WORDS).bit_length())
    answers = None
    for sizes in ROUNDS:
        ask = _asked(sizes, shard_bits)
        if answers is None:
            questions = units.mapInArrow(_first_round(ask), QUESTION)
        else:
            questions = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_later_round(ask), QUESTION)
        new = stored(questions.groupBy("shard", "size").applyInArrow(_counted, ANSWER), "answers")
        answers = new if answers is None else answers.union(new)
    packed_rows = "shard int, part int, told binary"
    told = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_told(shard_bits, max(1, n // MERGED)), packed_rows)
    merged = told.groupBy("shard", "part").applyInArrow(_merged, packed_rows)
    return merged.groupBy("shard").applyInArrow(_final, "lang string, size int, phrase string, a long")


def _joined(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score of all candidates; counts as `frequent` gives them."""
    # Stored, so that Spark knows its size: a row for each language.
    numbers = stored(counts.where("size = 0").select("lang", F.col("a").alias("n")), "numbers")
    parts = counts.where("size > 0").select("lang", "phrase", "a")
    words, k = F.split("phrase", " "), F.col("k")
    cuts = counts.where("size > 1").select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _joined(words, F.lit(1), k), "rest": _joined(words, k + 1, F.col("size") - k)})
    known = (
        cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
        .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
        .join(numbers, "lang")
    )

    def wide(c: str) -> Column:
        return F.col(c).cast("decimal(17,0)")

    exact = known.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")), "under": wide("l") * wide("r")})
    lowest = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r", "n", "a")).alias("cut")
    return exact.groupBy("lang", "phrase", "size").agg(lowest).select("lang", "phrase", "size", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """The candidates that no longer one contains as often as they occur."""
    words = F.split("phrase", " ")
    place = F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n_inside") + 1)).alias("at")
    inside = (
        candidates.where("size > 2").select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n_inside"))
        .select("lang", "phrase", "a", "n_inside", place)
        .select("lang", _joined(words, F.col("at"), F.col("n_inside")).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    )
    return candidates.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("a"))).drop("most")


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first of each language.

    The rows are sorted by range and stored; a rank is the place in the own range and the rows of the language in the ranges before, so no
    language meets in one task.
    """
    order = ["lang", F.col("score").desc(), F.col("a").desc(), "phrase"]
    rows = candidates.orderBy(*order).withColumn("place", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("range", F.shiftright("place", 33)), "ranked")
    own = rows.groupBy("lang", "range").agg(F.min("place").alias("begin"), F.count("*").alias("many"))
    earlier = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = own.withColumn("before", F.coalesce(F.sum("many").over(earlier), F.lit(0))).select("lang", "range", "begin", "before")
    rank = F.col("place") - F.col("begin") + F.col("before") + 1
    return rows.join(before, ["lang", "range"]).withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` collocations of each language."""
    counts = stored(frequent(docs), "phrases")
    return ranked(maximal(stored(scored(counts), "candidates")), top)
