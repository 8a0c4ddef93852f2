"""Byte-level BPE by recursive DuckDB queries, encoding and decoding.

Texts are split by the pattern. Each distinct match is encoded once per worker: its bytes are token-position rows that join the merge
table; every round contracts the leftmost pair of the lowest rank of each word, until none is left. A match that is a token itself is that token.
Decoding joins ids with the vocabulary and concatenates by ordered aggregation.

Null text: empty, no ids, the digest of nothing. Null doc_id stays. Repeated rows give repeated results. An empty table gives
an empty result. Texts of any length are read whole; matches of over `LONG` bytes, for which a round for each merge would not end,
are merged with a heap, to the same ids. Special tokens do not exist. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.llm.packing import Codes
from lotledger.llm.tables import ship, slices, texts_of, worker_cache

ship(__name__)

CACHED, ROUND_WORDS, LONG = 600_000, 60_000, 256

# A row is a token of a word at a place, with the token behind it. Rank and place make one number to compare by, and its
# upper bits are the token that the pair becomes.
ENCODE = """
with recursive state as (
  select word, place, token, next_token, false as done from start
  union all
  select word, place,
    case when key = best then (key >> 16)::int else token end as token,
    case when key = best then after_next when next_key = best then (next_key >> 16)::int else next_token end as next_token,
    best is null as done
  from (
    select word, place, token, next_token, key,
      min(key) over whole as best,
      lead(key) over ordered as next_key,
      lead(next_token) over ordered as after_next, lag(key) over ordered as last_key
    from (
      select s.word, s.place, s.token, s.next_token, m.merged::bigint * 65536 + s.place as key
      from state s left join merges m on m.token = s.token and m.next_token = s.next_token
      where not s.done
    )
    window ordered as (partition by word order by place),
      whole as (partition by word order by place rows between unbounded preceding and unbounded following)
  )
  where last_key is null or best is null or last_key <> best
)
select word, place, token from state where done order by word, place
"""
DECODE = """
select i.doc, string_agg(v.hex, '' order by i.place) as hex from ids i join vocabulary v on v.token = i.token group by i.doc
"""


def read_ranks(file: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file."""
    with open(file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs, one run after the other."""
    stops = np.cumsum(lengths)
    return np.repeat(starts - stops + lengths, lengths) + np.arange(lengths.sum())


class Codec:
    """Vocabulary and merge table in a DuckDB database of the worker's own, in memory."""

    def __init__(self, file: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(file)
        self.split = regex.compile(pattern)
        self.pair = regex.compile(r"\s\s")
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.sql.execute("set enable_progress_bar = false")
        pairs = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        names = ("token", "next_token", "merged")
        merges = pa.table({n: pa.array(x, pa.int32()) for n, x in zip(names, zip(*pairs, strict=True), strict=True)})
        vocabulary = pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        self.sql.register("merges_in", merges)
        self.sql.register("vocabulary_in", vocabulary)
        self.sql.execute("create table merges as from merges_in")
        self.sql.execute("create table vocabulary as from vocabulary_in")
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.clear()

    def clear(self) -> None:
        self.chunk = Codes()
        self.words: dict[str, int] = {}
        self.word_starts = self.word_lengths = self.starts = self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words by the recursive query, one word after the other, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        token = self.bytes[data]
        stops = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        following = np.append(token[1:], 0)
        last = np.zeros(len(token), bool)
        last[stops - 1] = True
        self.sql.register("start", pa.table({
            "word": word, "place": (np.arange(len(token)) - np.repeat(stops - lengths, lengths)).astype(np.int32),
            "token": token, "next_token": pa.array(following, pa.int32(), mask=last),
        }))
        out = self.sql.execute(ENCODE).fetchnumpy()
        self.sql.unregister("start")
        return out["token"].astype(np.int32), np.bincount(out["word"], minlength=len(words))

    def merged_long(self, word: bytes) -> np.ndarray:
        """The same with a heap of pairs, for one very long word."""
        parts: list = [word[i : i + 1] for i in range(len(word))]
        following, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def push(i: int) -> None:
            j = following[i]
            if j < len(parts) and (rank := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or following[i] >= len(parts) or parts[j := following[i]] != b:
                continue
            parts[i], parts[j] = a + b, None
            following[i] = following[j]
            if following[i] < len(parts):
                before[following[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([self.ranks[p] for p in parts if p is not None], np.int32)

    def learn(self, chunks: list[str]) -> None:
        """Ids of pieces of text, each match of the pattern on its own."""
        matches = [[c] if c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else self.split.findall(c) for c in chunks]
        self.add_words([w for w in dict.fromkeys(itertools.chain.from_iterable(matches)) if w not in self.words])
        numbers = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(matches)), np.int64)
        counts = np.fromiter(map(len, matches), np.int64, len(matches))
        firsts = np.cumsum(counts) - counts
        each = self.word_lengths[numbers]
        after = np.concatenate([[0], np.cumsum(each)])
        lengths = after[firsts + counts] - after[firsts]
        # A piece that is one match has the place of its word; the ids of others are put together behind all words.
        alone, starts = counts == 1, np.zeros(len(matches), np.int64)
        starts[alone] = self.word_starts[numbers[firsts[alone]]]
        starts[~alone] = len(self.flat) + np.cumsum(lengths[~alone]) - lengths[~alone]
        inside = np.repeat(~alone, counts)
        together = self.flat[_places(self.word_starts[numbers[inside]], each[inside])]
        self.flat = np.concatenate([self.flat, together])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])

    def add_words(self, words: list[str]) -> None:
        """Keep the ids of new words."""
        whole, rest, names, ids, lengths = [], [], [], [], []
        for word in words:
            data = word.encode()
            if (rank := self.ranks.get(data)) is not None:
                names.append(word)
                whole.append(rank)
            else:
                rest.append((word, data))
        ids.append(np.array(whole, np.int32))
        lengths.append(np.ones(len(whole), np.int64))
        for word, data in rest:
            if len(data) > LONG:
                names.append(word)
                ids.append(self.merged_long(data))
                lengths.append(np.array([len(ids[-1])]))
        short = [(w, d) for w, d in rest if len(d) <= LONG]
        for i in range(0, len(short), ROUND_WORDS):
            part = short[i : i + ROUND_WORDS]
            names += [w for w, _ in part]
            found = self.merged([d for _, d in part])
            ids.append(found[0])
            lengths.append(found[1])
        sizes = np.concatenate(lengths)
        self.words.update(zip(names, range(len(self.words), len(self.words) + len(names)), strict=True))
        self.word_starts = np.concatenate([self.word_starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.word_lengths = np.concatenate([self.word_lengths, sizes])
        self.flat = np.concatenate([self.flat, *ids])

    def chunks(self, text: str) -> list[str]:
        """The text in pieces that no match of the pattern crosses.

        Where white space only stands singly, a space begins a match and a line feed is one. Other texts are split by the pattern itself.
        """
        if "\x01" in text or self.pair.search(text):
            return self.split.findall(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text begins, with the end."""
        if len(self.chunk) > CACHED or len(self.words) > CACHED:
            self.clear()
        pieces: list[str] = []
        stops = [0]
        for text in texts:
            pieces += self.chunks(text)
            stops.append(len(pieces))
        codes = np.fromiter(map(self.chunk.__getitem__, pieces), np.int64, len(pieces))
        if self.chunk.new:
            self.learn(self.chunk.new)
            self.chunk.new = []
        lengths = self.lengths[codes]
        after = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[_places(self.starts[codes], lengths)], after[stops]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text from its ids."""
        self.sql.register("ids", pa.table({
            "doc": np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets)), "place": np.arange(len(ids), dtype=np.int32), "token": ids,
        }))
        found = self.sql.execute(DECODE).fetchnumpy()
        self.sql.unregister("ids")
        texts = dict(zip(found["doc"].tolist(), found["hex"].tolist(), strict=True))
        return [bytes.fromhex(texts.get(k, "")) for k in range(len(offsets) - 1)]


def codec(file: str, pattern: str) -> Codec:
    cache = worker_cache("codecs")
    if (file, pattern) not in cache:
        cache[file, pattern] = Codec(file, pattern)
    return cache[file, pattern]


def _encoded(file: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                ids, offsets = own.encode(texts_of(part).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """doc_id, ids of every text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(file, pattern), "doc_id long, ids array<int>")


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` ids each, or one text."""
    stops = batch.column("ids").offsets.to_numpy()
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(stops, stops[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _digested(file: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file, pattern)
        for batch in batches:
            for part in _parts(batch, 1 << 18):
                lists = part.column("ids")
                ids, offsets = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                view = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                sums = [hashlib.sha256(view[4 * a : 4 * b]).hexdigest() for a, b in itertools.pairwise(offsets.tolist())]
                texts = [hashlib.sha256(x).hexdigest() for x in own.decode(ids.astype(np.int32), offsets)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def digests(encoded: DataFrame, file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded texts; the decoded bytes come from the ids alone."""
    return encoded.mapInArrow(_digested(file, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
