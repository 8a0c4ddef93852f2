"""Removal of passages that an earlier document holds, by a count-min prefilter and an exact second pass.

A window is 13 consecutive words. A word goes where a window covers it whose words also start in a document with a smaller
doc_id; windows are judged on the input.

1. Every unit of documents sketches its windows; the partition sketches are merged, shard by shard, with counters that
   stop at two. The width follows the number of words, so the sketch stays as selective at any size. Estimates are never too
   low: a window that two documents share is always estimated repeated.
2. Units ask only about windows estimated repeated, each once, with the smallest doc_id of the unit. The exact groups answer
   which ones an earlier document of another unit holds. So a window costs at most one row entry per unit, however frequent it is.

Words are told apart by 64-bit hashes, windows by 128 bits. Null or empty text: no words, nothing removed. Null doc_id: later
than every id; such documents do not count as earlier than each other. Repeated rows of a doc_id keep what no smaller id holds.
An empty table gives an empty result. Texts of any length are read whole. Other columns pass through unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.llm.tables import ship, stored, texts_of
from lotledger.llm.units import in_units, packed, rows_of, unpacked
from lotledger.llm.words import raw, span_hashes, window_hashes, word_spans

ship(__name__)

SIZE, SKETCH_ROWS, CELLS_A_WORD, SHARD_WINDOWS = 13, 2, 4, 1 << 21
NO_ID = (1 << 63) - 1
ASKED = "shard int, unit long, cells binary, more binary"
ANSWER = "unit long, kind int, shard int, bits binary"


class Windows:
    """All windows of a unit's documents, sorted by hash."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.texts = texts_of(rows)
        self.data, self.offsets = raw(self.texts)
        self.starts, self.ends, self.counts = word_spans(self.data, self.offsets)
        words = span_hashes(self.data, self.starts, self.ends)
        first, self.place, number = window_hashes(words, self.counts, SIZE)
        self.keys = (first, window_hashes(words, self.counts, SIZE, 1)[0])
        ids = pc.fill_null(rows.column("doc_id").cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
        self.ids = np.repeat(ids, number)

    def cells(self, bits: int, row: int) -> np.ndarray:
        return self.keys[row] >> np.uint64(64 - bits)


def _shards(ascending: np.ndarray, bits: int, shard_bits: int) -> Iterator[tuple[int, int, int]]:
    """Shard, and where it begins and ends among ascending cells or hashes of so many bits; shards without any are left out."""
    number = ascending >> np.uint64(bits - shard_bits) if shard_bits else np.zeros(len(ascending), np.uint64)
    edges = np.flatnonzero(np.diff(number)) + 1 if len(number) else np.zeros(0, np.int64)
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)], strict=True):
        if b > a:
            yield int(number[a]), a, b


def _sketched(bits: int, shard_bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                windows = Windows(rows_of(batch, k))
                out: list[tuple] = []
                for row in range(SKETCH_ROWS):
                    cells, counts = np.unique(windows.cells(bits, row), return_counts=True)
                    for shard, a, b in _shards(cells, bits, shard_bits):
                        more = np.packbits(counts[a:b] > 1).tobytes()
                        out.append((row << shard_bits | shard, batch.column("unit")[k].as_py(), packed(cells[a:b]), more))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("shard", "unit", "cells", "more"), x, strict=True)) for x in out],
                    pa.schema([("shard", pa.int32()), ("unit", pa.int64()), ("cells", pa.binary()), ("more", pa.binary())]),
                )

    return run


ANSWERS = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())])


def _merged(bits: int, shard_bits: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        """The sketches of one shard added up; for each unit, which of its cells count two or more."""
        counters = np.zeros(1 << (bits - shard_bits), np.uint8)
        within = np.uint64((1 << (bits - shard_bits)) - 1)
        asked = [unpacked(x.as_py()) & within for x in group.column("cells")]
        for cells, more in zip(asked, group.column("more"), strict=True):
            twice = np.unpackbits(np.frombuffer(more.as_py(), np.uint8), count=len(cells))
            counters[cells] = np.minimum(counters[cells] + 1 + twice, 2)
        flags = [np.packbits(counters[cells] > 1).tobytes() for cells in asked]
        n = group.num_rows
        return pa.table([group.column("unit"), pa.array([0] * n, pa.int32()), group.column("shard"), pa.array(flags, pa.binary())], schema=ANSWERS)

    return run


def _repeated(windows: Windows, answers: pa.Table, bits: int, shard_bits: int) -> np.ndarray:
    """The windows that every row of the merged sketch puts at two or more, in order of their first key."""
    flags = {
        shard: b for kind, shard, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "bits")), strict=True) if kind == 0
    }
    at = np.argsort(windows.keys[0])
    for row in range(SKETCH_ROWS):
        own = windows.cells(bits, row)
        cells = np.unique(own)
        many = np.zeros(len(cells), bool)
        for shard, a, b in _shards(cells, bits, shard_bits):
            many[a:b] = np.unpackbits(np.frombuffer(flags[row << shard_bits | shard], np.uint8), count=b - a)
        many = np.append(cells[many], np.uint64(NO_ID))
        at = at[many[np.searchsorted(many, own[at])] == own[at]]
    return at


def _distinct(windows: Windows, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows `at` in key order: their index, the distinct one of each, and of the distinct ones both keys and the smallest id."""
    x, y, ids = windows.keys[0][at], windows.keys[1][at], windows.ids[at]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        order = np.lexsort((y, x))
        at, x, y, ids = at[order], x[order], y[order], ids[order]
    new = np.ones(len(at), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(ids, first) if len(first) else ids
    return at, np.cumsum(new) - 1, x[first], y[first], least


def _questions(bits: int, shard_bits: int) -> Callable:
    schema = pa.schema([("shard", pa.int32()), ("unit", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("least", pa.binary())])

    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for k in range(units.num_rows):
            windows = Windows(rows_of(units, k))
            _, _, x, y, least = _distinct(windows, _repeated(windows, answers, bits, shard_bits))
            for shard, a, b in _shards(x, 64, shard_bits):
                out.append((shard, units.column("unit")[k].as_py(), packed(x[a:b]), y[a:b].tobytes(), least[a:b].tobytes()))
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return run


def _grouped(group: pa.Table) -> pa.Table:
    """Exact groups of the windows of one shard; for each unit, which ones another unit's document with a smaller id holds."""
    xs = [unpacked(v.as_py()) for v in group.column("x")]
    sizes = [len(v) for v in xs]
    x = np.concatenate(xs)
    y = np.concatenate([np.frombuffer(v.as_py(), np.uint64) for v in group.column("y")])
    ids = np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in group.column("least")])
    order = np.lexsort((y, x))
    a, b = x[order], y[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    earlier = np.empty(len(a), bool)
    earlier[order] = least[np.cumsum(new) - 1] < ids[order]
    flags = [np.packbits(part).tobytes() for part in np.split(earlier, np.cumsum(sizes)[:-1])]
    n = group.num_rows
    return pa.table([group.column("unit"), pa.array([1] * n, pa.int32()), group.column("shard"), pa.array(flags, pa.binary())], schema=ANSWERS)


def _removed(windows: Windows, answers: pa.Table, bits: int, shard_bits: int) -> np.ndarray:
    """Which words of the unit go."""
    at, group, x, _, least = _distinct(windows, _repeated(windows, answers, bits, shard_bits))
    told = {
        shard: b for kind, shard, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "bits")), strict=True) if kind == 1
    }
    earlier = np.zeros(len(x), bool)
    for shard, a, b in _shards(x, 64, shard_bits):
        earlier[a:b] = np.unpackbits(np.frombuffer(told[shard], np.uint8), count=b - a)
    gone = windows.place[at[earlier[group] | (least[group] < windows.ids[at])]]
    change = np.zeros(len(windows.starts) + 1, np.int64)
    np.add.at(change, gone, 1)
    np.add.at(change, gone + SIZE, -1)
    return np.cumsum(change)[:-1] > 0


def _kept(windows: Windows, gone: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    out = []
    stops = np.cumsum(windows.counts)
    lost = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), np.minimum(stops - windows.counts, len(gone))) if len(stops) else []
    for text, a, b, n in zip(windows.texts.cast(pa.binary()).to_pylist(), (stops - windows.counts).tolist(), stops.tolist(), lost, strict=True):
        words = text.split()
        if n and b > a:
            words = [words[i] for i in np.flatnonzero(~gone[a:b]).tolist()]
        out.append(b" ".join(words))
    return out


def _applied(bits: int, shard_bits: int, finish: Callable) -> Callable:
    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for k in range(units.num_rows):
            rows = rows_of(units, k)
            windows = Windows(rows)
            gone = _removed(windows, answers, bits, shard_bits)
            sums = np.concatenate([[0], np.cumsum(gone)])
            stops = np.cumsum(windows.counts)
            out.append(finish(rows, windows.counts, sums[stops] - sums[stops - windows.counts], _kept(windows, gone)))
        return pa.concat_tables(out)

    return run


def remove_repeats(docs: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(rows, n_words, n_removed, kept) makes a table of that schema from a unit's rows; kept: the joined kept words."""
    units = in_units(docs)
    total = units.agg(F.sum("n_words")).first()[0] or 0
    bits = max(10, (CELLS_A_WORD * total).bit_length())
    shard_bits = max(0, (total // SHARD_WINDOWS).bit_length())
    sketches = units.mapInArrow(_sketched(bits, shard_bits), ASKED)
    many = stored(sketches.groupBy("shard").applyInArrow(_merged(bits, shard_bits), ANSWER), "answers")
    questions = units.groupBy("unit").cogroup(many.groupBy("unit")).applyInArrow(
        _questions(bits, shard_bits), "shard int, unit long, x binary, y binary, least binary"
    )
    earlier = questions.groupBy("shard").applyInArrow(_grouped, ANSWER)
    answers = many.union(earlier)
    return units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_applied(bits, shard_bits, finish), schema)


def _digest(rows: pa.RecordBatch, words: np.ndarray, removed: np.ndarray, kept: list[bytes]) -> pa.Table:
    return pa.table({
        "doc_id": rows.column("doc_id").cast(pa.int64()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
    })


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return remove_repeats(docs.select("doc_id", "text"), _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _rewritten(rows: pa.RecordBatch, words: np.ndarray, removed: np.ndarray, kept: list[bytes]) -> pa.Table:
    """The rows with the kept words as text where words went, and n_chars counted anew there."""
    changed = pa.array(removed > 0, pa.bool_())
    new = pa.array(kept, pa.binary()).cast(pa.string())
    columns = dict(zip(rows.schema.names, rows.columns, strict=True))
    columns["text"] = pc.if_else(changed, new, rows.column("text"))
    if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
        columns["n_chars"] = pc.if_else(changed, pc.utf8_length(new).cast(columns["n_chars"].type), columns["n_chars"])
    return pa.table(columns)


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs; texts that lost words hold the kept ones joined by one space, other texts stay as they are."""
    return remove_repeats(docs, _rewritten, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
