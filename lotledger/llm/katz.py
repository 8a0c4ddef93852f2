"""Katz backoff scoring: Good-Turing discounted counts with exactly normalised backoff weights.

A text's tokens are its words (A-Z in lower case) and one end. The model: a bigram seen in training has its discounted share of its
history's count; one not seen has the history's backoff weight times the word's unigram probability; the weight makes all probabilities
of a history add up to 1. Unigrams are discounted too; what that frees is the probability of an unknown word.
A history that was never seen backs off with weight 1.

Counts up to `MOST` are discounted by Good and Turing's rule; where the counts of counts do not allow that (none, or not falling), by the absolute
discount n1 / (n1 + 2 n2). A history whose counts are all higher gives one more count to the words not seen after it.

Units of documents ask for the counts of their distinct words, then of their distinct bigrams, packed by shard; answers are written tables.
Bigrams lie by history. A history with more than `SHARD` tokens is dealt out over several groups by word, and what its weight
needs is added up afterwards. So a frequent word costs a row entry per unit, and no task holds a whole history.

Null or empty text: one token, the end. Null doc_id: not held out. Repeated rows count each time. Without any training token all unknown words have
probability 1. An empty table gives an empty result. Other columns are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotledger.llm.tables import ship, stored, texts_of
from lotledger.llm.units import in_units, joined, packed, parted, planes, rows_of, unpacked, unplanes
from lotledger.llm.words import mixed, word_hashes

ship(__name__)

FOLDS, MOST, SHARD, KEY_BYTES, FINE = 10, 5, 1 << 20, 5, 1 << 44
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0xFFFFFFFFFFFFFFFF)
WORDS, BIGRAMS, HOT_PART, HOT_ASKED, HOT, TOTALS = range(6)
ANSWER = pa.schema([
    ("unit", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("salt", pa.int32()), ("data", pa.binary()),
    ("numbers", pa.list_(pa.int64())), ("mass", pa.float64()),
])
ANSWER_DDL = "unit long, kind int, part long, salt int, data binary, numbers array<long>, mass double"


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(ANSWER.names, r, strict=True)) for r in rows], ANSWER)


class Tokens:
    """Words and their histories in a unit."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        hashes, counts = word_hashes(texts_of(rows), lower=True)
        self.ids = rows.column("doc_id").cast(pa.int64())
        self.held_out = np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in self.ids.to_pylist()], bool)
        self.counts = counts + 1
        self.stops = np.cumsum(self.counts)
        word = np.full(int(self.stops[-1]) if len(counts) else 0, END)
        inner = np.ones(len(word), bool)
        inner[self.stops - 1] = False
        word[inner] = hashes
        self.learnt = np.repeat(~self.held_out, self.counts)
        self.words, self.word = np.unique(word, return_inverse=True)

    def learnt_counts(self) -> np.ndarray:
        return np.bincount(self.word[self.learnt], minlength=len(self.words))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of history and word as numbers, and the one of each token. BEGIN is the last history."""
        history = np.empty_like(self.word)
        history[1:] = self.word[:-1]
        history[self.stops - self.counts] = len(self.words)
        return np.unique(history * (len(self.words) + 1) + self.word, return_inverse=True)


def _cuts(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Shard, begin and end of ascending hashes by their upper bits."""
    if not len(hashes):
        return []
    shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(hashes)]
    return [(int(shard[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _word_questions(bits: int) -> Callable:
    schema = pa.schema([("part", pa.int64()), ("unit", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = Tokens(rows_of(batch, k))
                counts = own.learnt_counts()
                rows = [(s, batch.column("unit")[k].as_py(), joined([packed(own.words[a:b]), planes(counts[a:b])])) for s, a, b in _cuts(own.words, bits)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return run


def _totals(counts: np.ndarray) -> list[int]:
    """Distinct, tokens, and how many have each count up to MOST + 1."""
    many = np.bincount(np.minimum(counts, MOST + 2), minlength=MOST + 3)
    return [int((counts > 0).sum()), int(counts.sum()), *many[1 : MOST + 2].tolist()]


def _word_answers(group: pa.Table) -> pa.Table:
    asked = [parted(x.as_py()) for x in group.column("data")]
    words = [unpacked(x) for x, _ in asked]
    counts = np.concatenate([unplanes(x, np.int64) for _, x in asked])
    _, back = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros(int(back.max()) + 1, np.int64)
    np.add.at(total, back, counts)
    shares = np.split(total[back], np.cumsum([len(w) for w in words])[:-1])
    part = group.column("part")[0].as_py()
    rows = [(u, WORDS, part, 0, joined([planes(s)]), None, None) for u, s in zip(group.column("unit").to_pylist(), shares, strict=True)]
    return _answers([*rows, (-1, TOTALS, WORDS, 0, None, _totals(total), None)])


def discounts(many: list[int]) -> np.ndarray:
    """What part of a count stays, by count; the last entry, 1, is for all counts over MOST. many: how many have each count from 1 to MOST + 1."""
    out = np.ones(MOST + 2)
    n = np.array([0, *many], float)
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    over = (MOST + 1) * n[MOST + 1] / n[1] if n[1] else 1.0
    for r in range(1, MOST + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over) if n[r] and over < 1 else 0.0
        out[r] = turing if 0 < turing < 1 else 1 - absolute / r
    return out


class Unigrams:
    """Probabilities of words by their training count."""

    def __init__(self, totals: list[int]) -> None:
        self.distinct, self.tokens, *many = totals
        self.kept = discounts(many)
        freed = sum(n * r * (1 - self.kept[r]) for r, n in enumerate(many[:MOST], 1))
        if freed <= 0:
            self.kept[:] = 1.0
        self.size = self.tokens + (freed <= 0)
        self.unknown = (freed if freed > 0 else 1) / max(self.size, 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.kept[np.minimum(counts, MOST + 1)] * counts / max(self.size, 1), self.unknown)


class Asked:
    """The bigrams of a unit in the order of its questions."""

    def __init__(self, own: Tokens, answers: pa.Table, bits: int) -> None:
        told = {
            part: data for kind, part, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "data")), strict=True) if kind == WORDS
        }
        self.counts = np.concatenate([unplanes(parted(told[s])[0], np.int64) for s, _, _ in _cuts(own.words, bits)])
        self.pairs, self.of_token = own.bigrams()
        wide = len(own.words) + 1
        self.history, self.word = np.divmod(self.pairs, wide)
        self.hashes = np.append(own.words, BEGIN)
        begins = self.counts[np.searchsorted(own.words, END)]
        self.as_history = np.append(self.counts, begins)
        # Histories that fill more than a shard are dealt out by word.
        salts = np.maximum(1, -(-self.as_history // SHARD))[self.history]
        key = own.words[self.word] >> np.uint64(8 * KEY_BYTES)
        salt = np.where(salts > 1, 1 + key.astype(np.int64) % salts, 0)
        part = self.hashes[self.history] >> np.uint64(2)
        usual = self.hashes[self.history] >> np.uint64(64 - bits) if bits else np.zeros(len(part), np.uint64)
        part = np.where(salts > 1, part, usual).astype(np.int64)
        order = np.lexsort((salt, part)) if (salts > 1).any() else np.arange(len(part))
        new = (np.diff(part[order]) != 0) | (np.diff(salt[order]) != 0)
        self.slices = np.split(order, np.flatnonzero(new) + 1) if len(order) else []
        self.names = [(int(part[s[0]]), int(salt[s[0]])) for s in self.slices]


def _histories(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of an ascending list, and how often each occurs."""
    first = np.flatnonzero(np.diff(history, prepend=-1))
    return history[first], np.diff(first, append=len(history))


QUESTION = "part long, salt int, unit long, data binary"


def _bigram_questions(bits: int) -> Callable:
    schema = pa.schema([("part", pa.int64()), ("salt", pa.int32()), ("unit", pa.int64()), ("data", pa.binary())])

    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for k in range(units.num_rows):
            own = Tokens(rows_of(units, k))
            asked = Asked(own, answers, bits)
            learnt = np.bincount(asked.of_token[own.learnt], minlength=len(asked.pairs))
            for (part, salt), at in zip(asked.names, asked.slices, strict=True):
                history, sizes = _histories(asked.history[at])
                word = asked.word[at]
                # Within one history of one group, KEY_BYTES of a word's hash tell words apart; other bits deal them out.
                data = joined([packed(asked.hashes[history]), planes(sizes), planes(own.words[word], KEY_BYTES), planes(learnt[at]), planes(asked.counts[word])])
                rows.append((part, salt, units.column("unit")[k].as_py(), data))
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return run


def _bigram_answers(unigrams: Unigrams) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        asked = list(zip(*[parted(x.as_py()) for x in group.column("data")], strict=True))
        histories, sizes = [unpacked(x) for x in asked[0]], [unplanes(x, np.int64) for x in asked[1]]
        words = np.concatenate([unplanes(x, np.uint64, KEY_BYTES) for x in asked[2]])
        counts, lower = (np.concatenate([unplanes(x, np.int64) for x in blocks]) for blocks in asked[3:])
        distinct, back = np.unique(np.concatenate(histories), return_inverse=True)
        history = np.repeat(back, np.concatenate(sizes))
        key = mixed(history.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ words)
        order = np.argsort(key)
        key = key[order]
        new = np.diff(key, prepend=key[0] + np.uint64(1)) != 0
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], first)
        of_entry = np.empty(len(order), np.int64)
        of_entry[order] = np.cumsum(new) - 1
        one = order[first][total > 0]
        seen = total[total > 0]
        n = len(distinct)
        facts = [np.bincount(history[one], seen == r, minlength=n).astype(np.int64) for r in range(1, MOST + 1)]
        facts.append(np.bincount(history[one], seen * (seen > MOST), minlength=n).astype(np.int64))
        mass = np.bincount(history[one], unigrams(lower[one]), minlength=n)
        fine = np.rint(mass * FINE).astype(np.int64)  # few distinct bytes, right to 3e-14
        part, salt = group.column("part")[0].as_py(), group.column("salt")[0].as_py()
        rows = [(-1, TOTALS, BIGRAMS, 0, None, _totals(seen), None)]
        stops = np.cumsum([int(s.sum()) for s in sizes])
        for unit, own, a, b in zip(group.column("unit").to_pylist(), np.split(back, np.cumsum([len(h) for h in histories])[:-1]), [0, *stops[:-1]], stops, strict=True):
            blocks = [planes(total[of_entry[a:b]])]
            if salt:
                rows += [(unit, HOT_ASKED, None, 0, None, [int(h)], None) for h in distinct[own].view(np.int64)]
            else:
                blocks += [planes(x[own]) for x in facts] + [planes(fine[own])]
            rows.append((unit, BIGRAMS, part, salt, joined(blocks), None, None))
        if salt:
            for k, h in enumerate(distinct.view(np.int64)):
                rows.append((-1, HOT_PART, None, 0, None, [int(h), *(int(x[k]) for x in facts)], float(mass[k])))
        return _answers(rows)

    return run


def _scores(bits: int, unigrams: Unigrams, kept: np.ndarray) -> Callable:
    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        out = [_scored(Tokens(rows_of(units, k)), answers, bits, unigrams, kept) for k in range(units.num_rows)]
        return pa.concat_tables(out)

    return run


def _scored(own: Tokens, answers: pa.Table, bits: int, unigrams: Unigrams, kept: np.ndarray) -> pa.Table:
    asked = Asked(own, answers, bits)
    told, hot = {}, []
    for kind, part, salt, data, numbers, mass in zip(*(answers.column(c).to_pylist() for c in ANSWER.names[1:]), strict=True):
        if kind == BIGRAMS:
            told[part, salt] = parted(data)
        elif kind == HOT:
            hot.append((numbers, mass))
    count = np.zeros(len(asked.pairs), np.int64)
    facts = np.zeros((MOST + 1, len(asked.hashes)), np.int64)
    mass = np.zeros(len(asked.hashes))
    for name, at in zip(asked.names, asked.slices, strict=True):
        blocks = told[name]
        count[at] = unplanes(blocks[0], np.int64)
        if len(blocks) > 1:
            history, _ = _histories(asked.history[at])
            facts[:, history] = [unplanes(x, np.int64) for x in blocks[1:-1]]
            mass[history] = unplanes(blocks[-1], np.int64) / FINE
    for (h, *numbers), share in hot:
        k = int(np.searchsorted(asked.hashes, np.array([h], np.int64).view(np.uint64))[0])
        facts[:, k], mass[k] = numbers, share
    r = np.arange(1, MOST + 1)[:, None]
    size = (facts[:MOST] * r).sum(0) + facts[MOST]
    left = (facts[:MOST] * r * (1 - kept[1 : MOST + 1, None])).sum(0)
    full = (left <= 0) & (size > 0)  # nothing is freed: one more count
    left, size, stays = np.where(full, 1.0, left), size + full, np.where(full[:, None], 1.0, kept[None, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(size > 0, left / size / (1 - mass), 1.0)
        lower = unigrams(asked.counts)
        seen = stays[asked.history, np.minimum(count, MOST + 1)] * count / size[asked.history]
        chance = np.where(count > 0, seen, weight[asked.history] * lower[asked.word])
        base = np.log10((asked.counts + 0.1) / (unigrams.tokens + 0.1 * (unigrams.distinct + 1)))
    begin = own.stops - own.counts
    of_docs = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)
    return pa.table({
        "doc_id": own.ids, "held_out": pa.array(own.held_out), "n_tokens": pa.array(own.counts, pa.int64()),
        "n_known": pa.array(of_docs((asked.counts > 0)[own.word].astype(np.int64)), pa.int64()),
        "train_tokens": pa.array(np.full(len(begin), unigrams.tokens), pa.int64()),
        "base_score": pa.array(of_docs(base[own.word]), pa.float64()),
        "score": pa.array(of_docs(np.log10(chance)[asked.of_token]), pa.float64()),
    })


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _summed(answers: DataFrame, what: int) -> list[int]:
    """The totals of all shards."""
    numbers = [F.sum(F.col("numbers")[i]) for i in range(MOST + 3)]
    return [x or 0 for x in answers.where((F.col("kind") == TOTALS) & (F.col("part") == what)).agg(*numbers).first()]


def score(docs: DataFrame) -> DataFrame:
    """Every text's log10 probability, learnt from the rows that are not held out."""
    units = in_units(docs.select("doc_id", "text"))
    total = units.agg(F.sum("n_words")).first()[0] or 0
    bits = max(0, (total // SHARD).bit_length())
    by_unit = units.groupBy("unit")
    asked = units.mapInArrow(_word_questions(bits), "part long, unit long, data binary")
    words = stored(asked.groupBy("part").applyInArrow(_word_answers, ANSWER_DDL), "katz-words")
    unigrams = Unigrams(_summed(words, WORDS))
    told = words.where(F.col("kind") == WORDS)
    pairs = by_unit.cogroup(told.groupBy("unit")).applyInArrow(_bigram_questions(bits), QUESTION)
    bigrams = stored(pairs.groupBy("part", "salt").applyInArrow(_bigram_answers(unigrams), ANSWER_DDL), "katz-bigrams")
    kept = discounts(_summed(bigrams, BIGRAMS)[2:])
    number = F.col("numbers")
    parts = bigrams.where(F.col("kind") == HOT_PART).groupBy(number[0].alias("h")).agg(
        F.array(F.col("h"), *[F.sum(number[i]) for i in range(1, MOST + 2)]).alias("numbers"), F.sum("mass").alias("mass")
    )
    wanted = bigrams.where(F.col("kind") == HOT_ASKED).select("unit", number[0].alias("h")).distinct()
    hot = wanted.join(parts, "h").select(
        "unit", F.lit(HOT).alias("kind"), F.lit(None).cast("long").alias("part"), F.lit(0).alias("salt"),
        F.lit(None).cast("binary").alias("data"), "numbers", "mass",
    )
    answers = told.union(bigrams.where(F.col("kind") == BIGRAMS)).union(hot)
    return by_unit.cogroup(answers.groupBy("unit")).applyInArrow(_scores(bits, unigrams, kept), RESULT)
