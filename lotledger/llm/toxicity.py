"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over distinct words and beginnings of words is trained in numpy from confirmed toxic texts and from unlabelled texts, with the risk
    prior * E_toxic[loss(+)] + max(0, E_any[loss(-)] - prior * E_toxic[loss(-)]),
the second term being the risk on clean texts, which cannot be negative. The class prior is the share of toxic rows among the
labels it learns from. Features weigh as much as their log odds between both samples before training; those in fewer than `LEAST_TEXTS`
of the toxic texts are left out. Of near-equal texts in a sample, those with equal minima under three hash functions, each counts as its share of
one text, in counts and in risks, so a group of copies doesn't bring in its own words.

Samples are bounded: at most `TOXIC` confirmed and `ANY` unlabelled documents, those with the smallest hash of doc_id. Scoring
reads every whole text; labels, language, source and id are no inputs.

Null or empty text: scored by the bias alone. Null doc_id: scored, never learnt from, not held out. A repeated doc_id is learnt from
once; labels that differ count as toxic. Null labels confirm nothing. Without any confirmed toxic text all scores are 0. An empty
table gives an empty result. Other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.llm.tables import ship, slices, texts_of
from lotledger.llm.words import BYTE_BASES, WORD_BASES, lowered, raw, span_hashes, word_spans

ship(__name__)

TOXIC, ANY, BITS, FOLDS, PREFIXES = 4000, 12000, 20, 5, (4,)
LEAST_TEXTS, STEPS, RATE, DECAY = 5, 300, 0.05, 1e-4


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of every word and of its first bytes: letters and digits only, in lower case, hashed to `BITS` bits."""
    data, offsets = raw(texts)
    data = lowered(data)
    plain = ((data - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10) | (data >= 128)
    starts, ends, counts = word_spans(np.where(plain, data, np.uint8(32)), offsets)
    hashes = [span_hashes(data, starts, ends)]
    hashes += [span_hashes(data, starts, np.minimum(ends, starts + n)) * np.uint64(2 * n + 1) for n in PREFIXES]
    features = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.tile(np.repeat(np.arange(len(counts)), counts), len(hashes)), features


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            row, feature = word_features(texts_of(part))
            own = np.unique(row << BITS | feature)
            edges = np.searchsorted(own >> BITS, np.arange(part.num_rows + 1))
            own = (own & ((1 << BITS) - 1)).astype(np.int32)
            sets = [own[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "features"])


def _sampled(ids: DataFrame, most: int) -> list[int]:
    """At most `most` ids, those with the smallest hashes."""
    order = F.xxhash64("doc_id")
    return [r[0] for r in ids.select("doc_id").distinct().orderBy(order, "doc_id").limit(most).collect()]


def shares(rows: list[np.ndarray]) -> np.ndarray:
    """What each text counts: one, shared by texts whose features have equal minima under three hash functions."""
    classes: dict[tuple, list[int]] = {}
    for k, own in enumerate(rows):
        key = [((own.astype(np.uint64) + np.uint64(1)) * f >> np.uint64(20)).min(initial=np.uint64(1 << 44)) for f in (BYTE_BASES[0], *WORD_BASES)]
        classes.setdefault(tuple(key), []).append(k)
    out = np.zeros(len(rows))
    for members in classes.values():
        out[members] = 1 / len(members)
    return out


def _blocks(rows: list[np.ndarray], size: int = 512) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some texts at a time: the first, how many, and text and feature of each entry."""
    for a in range(0, len(rows), size):
        own = rows[a : a + size]
        yield a, len(own), np.repeat(np.arange(len(own), dtype=np.int32), [len(r) for r in own]), np.concatenate(own).astype(np.int32)


def train(toxic: list[np.ndarray], some: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights of all features and the bias. toxic, some: the distinct features of each text."""
    size = 1 << BITS
    per = [shares(rows) for rows in (toxic, some)]
    counts = [sum((np.bincount(f, w[a:][t], minlength=size) for a, _, t, f in _blocks(rows)), np.zeros(size)) for w, rows in zip(per, (toxic, some), strict=True)]
    share = [(c + 0.5) / (w.sum() + 1) for c, w in zip(counts, per, strict=True)]
    odds = np.where(counts[0] >= LEAST_TEXTS, np.log(share[0] / share[1]), 0.0)
    of_toxic, of_some = (w / max(w.sum(), 1e-9) for w in per)

    telling = np.flatnonzero(odds)
    number, odds, size = np.cumsum(odds != 0) - 1, odds[telling], len(telling)

    def used(rows: list[np.ndarray]) -> list[tuple]:
        out = []
        for a, n, text, feature in _blocks(rows):
            tells = np.isin(feature, telling)
            out.append((a, n, text[tells], number[feature[tells]].astype(np.int32)))
        return out

    of_blocks = used(toxic), used(some)
    weight, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    moments = np.zeros((2, size + 1))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, STEPS + 1):
        each = weight * odds
        zp, zu = (bias + np.concatenate([np.bincount(t, each[f], minlength=n) for _, n, t, f in blocks] or [np.zeros(0)]) for blocks in of_blocks)
        clean = of_some @ np.logaddexp(0, zu) - prior * (of_toxic @ np.logaddexp(0, zp))
        # Gradients of each text's loss: toxic as such, and both parts of the clean risk.
        gp, gu = -prior * (1 - sigmoid(zp)) * of_toxic, sigmoid(zu) * of_some
        back = -prior * sigmoid(zp) * of_toxic
        gp, gu = (gp + back, gu) if clean >= 0 else (-back, -gu)
        slope = sum((np.bincount(f, g[a:][t], minlength=size) for g, blocks in zip((gp, gu), of_blocks, strict=True) for a, _, t, f in blocks), np.zeros(size))
        slope = slope * odds + DECAY * weight
        both = np.append(slope, gp.sum() + gu.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * both
        moments[1] = 0.999 * moments[1] + 0.001 * both**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weight -= move[:-1]
        bias -= move[-1]
    out = np.zeros(1 << BITS, np.float32)
    out[telling] = weight * odds
    return out, float(bias)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The classifier from the rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    toxic = set(_sampled(known.where("toxic = 1").join(ids, "doc_id", "left_semi"), TOXIC))
    some = set(_sampled(ids, ANY))
    if not toxic:
        return np.zeros(1 << BITS, np.float32), -np.inf
    chosen = docs.sparkSession.createDataFrame([(x,) for x in sorted(toxic | some)], "doc_id long")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # TOXIC + ANY rows at most
    rows = {r[0]: np.frombuffer(r[1], np.int32) for r in text.dropDuplicates(["doc_id"]).mapInArrow(_features, "doc_id long, features binary").collect()}
    prior = min(max(n_toxic / n, 0.001), 0.9)
    return train([rows[x] for x in sorted(toxic)], [rows[x] for x in sorted(some)], prior)


def _scored(weight: np.ndarray, bias: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part in slices(batch, "text", 1 << 19):
                row, feature = word_features(texts_of(part))
                tells = weight[feature] != 0
                own = np.unique(row[tells] << BITS | feature[tells])
                margin = bias + np.bincount(own >> BITS, weight[own & ((1 << BITS) - 1)], minlength=part.num_rows)
                out.append(1 / (1 + np.exp(-np.clip(margin, -700, 700))) if np.isfinite(bias) else np.zeros(part.num_rows))
            scores = np.concatenate([*out, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, SCORE])

    return run


SCORE = "toxicity_score"


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs with a further column `toxicity_score`."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scored(*model), f"{fields}, {SCORE} double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below the threshold."""
    kept = docs.columns
    return scored(docs, fit(docs, labels)).where(F.col(SCORE) < threshold).select(*[F.col(f"`{c}`") for c in kept])
