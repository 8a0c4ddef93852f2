"""Best-fit packing of tokenised documents into sequences of a fixed length.

Only lengths matter for the packing, and there are at most `size` of them. So the plan is made from the number
of pieces of each length, a table of bounded size, and Spark deals the pieces into the planned places.

Plan: from the longest length down, gaps are filled exactly by one piece, else by a pair, else by a triple
whose lengths add up to the gap, as many times at once as the available pieces allow. What is left is placed
best-fit, longest first.

Null text: the document is empty, its only id is the end. Null doc_id stays null. A repeated row is a document
of its own. An empty table gives an empty result. Other columns are not read. Texts are read whole. Strings of special tokens
in a text count as the tokenizer file has them.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotledger.llm.tables import ship, slices, stored, texts_of, worker_cache

ship(__name__)

CACHED_WORDS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Codes(dict):
    """Numbers words as they come; `new` holds those not seen before."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, word: bytes | None) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordIds:
    """Ids of words, each word encoded once. Words are runs without ASCII white space, which the tokenizer drops."""

    def __init__(self, file: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.end = end
        self.ends = np.array([self.tokenizer.id_to_token(i).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.code = Codes()
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([self.end], np.uint32)
        self.code[None] = 0

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has.

        Many words of letters, with one sign behind or without, are encoded as one text: the tokenizer splits between letters
        and signs, so the number of end-of-word ids of each is known. If the numbers don't meet, words are encoded one by one.
        """
        plain = [w.decode() for w in words]
        parts = [1 if w.isalpha() else 2 if w[:-1].isalpha() and w[-1] in ".,;:!?" else 0 for w in plain]
        many = np.flatnonzero(parts)
        ids = np.fromiter(
            itertools.chain.from_iterable(self._encoded([" ".join(plain[k] for k in many[i : i + 512]) for i in range(0, len(many), 512)])), np.uint32
        )
        stops = np.flatnonzero(self.ends[ids]) + 1
        last = np.cumsum(np.array(parts)[many])
        if len(stops) != (last[-1] if len(last) else 0):
            many, ids, stops, last = many[:0], ids[:0], stops[:0], last[:0]
        one = np.setdiff1d(np.arange(len(words)), many)
        singly = self._encoded([plain[k] for k in one])
        lengths = np.zeros(len(words), np.int64)
        lengths[many] = np.diff(stops[last - 1], prepend=0)
        lengths[one] = [len(x) for x in singly]
        out = np.empty(int(lengths.sum()), np.uint32)
        joint = np.zeros(len(words), bool)
        joint[many] = True
        inside = np.repeat(joint, lengths)
        out[inside] = ids
        out[~inside] = np.fromiter(itertools.chain.from_iterable(singly), np.uint32)
        return out, lengths

    def learn(self, words: list[bytes]) -> None:
        flat, lengths = self._ids(words)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by the end, and where each text begins, with the end."""
        if len(self.code) > CACHED_WORDS:
            self.clear()
        words: list = []
        stops = []
        for text in texts:
            if text.isascii() and b"<|" not in text:  # the tokenizer lowers them as well
                text = text.lower()
            words += text.split()
            words.append(None)
            stops.append(len(words))
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if self.code.new:
            self.learn(self.code.new)
            self.code.new = []
        lengths = self.lengths[codes]
        after = np.cumsum(lengths)
        places = np.repeat(self.starts[codes] - (after - lengths), lengths)
        places += np.arange(len(places))
        return self.flat[places], np.concatenate([[0], after[np.array(stops) - 1]])


def _pieces(file: str, end: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("word_ids")
        if (file, end) not in cache:
            cache[file, end] = WordIds(file, end)
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                texts = texts_of(part).cast(pa.binary()).to_pylist()
                ids, offsets = cache[file, end].encode(texts)
                numbers = -(-np.diff(offsets) // size)
                row = np.repeat(np.arange(len(texts)), numbers)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
                begin = offsets[row] + piece * size
                stop = np.minimum(begin + size, offsets[row + 1])
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()),
                        pa.array(stop - begin, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def tokenised_pieces(docs: DataFrame, file: str, size: int, end: int = 0) -> DataFrame:
    """Pieces of at most `size` tokens of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(file, end, size), PIECES)


def _fitting(counts: np.ndarray, gap: int, used: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that add up to the gap; the longest first. used: a length taken once already."""
    left = counts[: gap + 1].copy()
    if used <= gap:
        left[used] -= 1
    if left[gap] > 0:
        return (gap,)

    def pair(total: int, most: int) -> tuple[int, int] | None:
        high = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        low = total - high
        ok = (left[high] > 0) & (left[low] > 0) & ((high != low) | (left[high] > 1))
        at = int(ok.argmax()) if len(ok) else 0
        return (int(high[at]), int(low[at])) if len(ok) and ok[at] else None

    if two := pair(gap, gap):
        return two
    present = np.flatnonzero(left > 0)
    for third in present[(present > 0) & (present * 3 <= gap)]:  # the smallest of the three
        left[third] -= 1
        two = pair(gap - int(third), gap)
        left[third] += 1
        if two and two[1] >= third:
            return (*two, int(third))
    return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings of a sequence and how many sequences get each. counts: the pieces of each length."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    for length in range(size - 1, 0, -1):
        while left[length] > 0 and (others := _fitting(left, size - length, length)):
            filling = (length, *others)
            need = {x: filling.count(x) for x in filling}
            times = int(min(left[x] // n for x, n in need.items()))
            for x, n in need.items():
                left[x] -= n * times
            out.append((filling, times))
    return out + _best_fit(left, size)


def _best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit of what is left, longest first, many equal sequences at a time."""
    bins: dict[int, list[list]] = {}  # by gap: [filling, how many]
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                each = min(size // length, n)
                opened = n // each
                bins.setdefault(size - each * length, []).append([(length,) * each, opened])
                n -= opened * each
                continue
            filling, have = bins[gap].pop()
            taken = min(have, n)
            if have > taken:
                bins[gap].append([filling, have - taken])
            if not bins[gap]:
                del bins[gap]
            bins.setdefault(gap - length, []).append([(*filling, length), taken])
            n -= taken
    return [(tuple(filling), n) for many in bins.values() for filling, n in many]


def places(fillings: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of places by length: from the rank `rank` on, `times` in each sequence from `sequence` on, the first at `offset`."""
    rows, used, sequence = [], {}, 0
    for filling, n in fillings:
        offset = 0
        for length, group in itertools.groupby(filling):
            times = len(list(group))
            rows.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * times
        sequence += n
    rows.sort()
    names = ("length", "rank", "times", "sequence", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def _placed(where: dict[str, np.ndarray], before: np.ndarray) -> Callable:
    """before: the pieces of a length in earlier salts, by length and salt."""
    wide = np.int64(1 << 50)
    keys = where["length"] * wide + where["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, number = (batch.column(c).to_numpy() for c in ("length", "salt", "number"))
            rank = before[length, salt] + number - 1
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            inside = rank - where["rank"][at]
            times = where["times"][at]
            sequence = where["sequence"][at] + inside // times
            offset = where["offset"][at] + inside % times * length
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, size: int = 2048, salts: int = 64) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces of one length are numbered salt by salt, so none of them meet in one task."""
    kept = stored(pieces, "pieces").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    numbers = np.zeros((size + 1, salts), np.int64)
    for length, salt, n in kept.groupBy("length", "salt").count().collect():  # at most size * salts rows
        numbers[length, salt] = n
    total = numbers.sum(1)
    where = places(plan({int(x): int(total[x]) for x in np.flatnonzero(total)}, size))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return kept.withColumn("number", F.row_number().over(order).cast("long")).mapInArrow(
        _placed(where, np.cumsum(numbers, 1) - numbers), PIECES + ", sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, file: str, size: int = 2048) -> DataFrame:
    return pack(tokenised_pieces(docs, file, size), size)
