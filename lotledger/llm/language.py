"""Language identification by a blended-spectrum string kernel.

A text is the set of its distinct n-grams of `ORDERS` letters (letters in lower case, every run of anything else is one space); the kernel
of two texts is the number of n-grams that both hold, over the root of the product of what each holds. N-grams are told apart by `BITS` bits.

1. A bounded sample of labelled texts is learnt from: per language those whose text hash is lowest, about `SAMPLE` / languages of them; copies count once.
2. `LANDMARKS` of these, the same number for each language, span the Nyström feature space: kernel values to the landmarks times the inverse
   root of the landmarks' own kernel matrix. One-versus-rest kernel ridge regression there gives a weight for each landmark and language.
3. Scoring reads every whole text: presence matrix of a batch times presence matrix of the landmarks gives the kernel values, these times
   the weights the decision values. The highest one tells the language; ties go to the language that sorts first. The score is the softmax of
   `SHARPNESS` times the decision values, of the language told.

Null text, or a text without a letter: `und`, score 0. Without anything learnt every text is `und`. Null language or null text: never learnt. Null
doc_id: learnt and not held out. One text with several languages counts in each. Long texts are read whole, in parts. Repeated rows get equal
answers. An empty table gives an empty result. Language, source and id are no inputs of a prediction, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.llm.tables import ship, slices, texts_of, worker_cache

ship(__name__)

ORDERS, BITS, FOLDS, HELD = (1, 2, 3, 4), 20, 4, 2
SAMPLE, LANDMARKS, RIDGE, SHARPNESS = 2400, 160, 1e-3, 8.0
PART, ROWS, UNKNOWN = 1 << 20, 64, "und"
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter; kept by the worker."""
    kept = worker_cache("letters")
    if not kept:
        kept["is"] = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)
    return kept["is"]


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    new = np.ones(len(numbers), bool)
    new[1:] = numbers[1:] != numbers[:-1]
    return numbers[new]


def spectrum(text: str) -> np.ndarray:
    """The distinct n-grams of a text, ascending, as numbers of `BITS` bits; none for a text without a letter."""
    letters, tail, held, any_letter = _letters(), np.zeros(0, np.uint64), [], False
    for at in range(0, len(text), PART):
        points = np.frombuffer(text[at : at + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters[points]
        any_letter |= bool(letter.any())
        own = np.concatenate([tail, np.where(letter, points, np.uint32(32)).astype(np.uint64)])
        blank = own == 32
        keep = np.ones(len(own), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        own = own[keep]
        grams, found = np.zeros(len(own) + 1, np.uint64), []
        for n in range(1, min(max(ORDERS), len(own)) + 1):
            grams = grams[:-1] * FACTOR + own[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                found.append((((grams ^ (grams >> np.uint64(29))) * SPREAD) >> np.uint64(64 - BITS)).astype(np.int32))
        held.append(_distinct(np.concatenate(found)))
        tail = own[-(max(ORDERS) - 1) :]
    if not any_letter:
        return np.zeros(0, np.int32)
    return held[0] if len(held) == 1 else _distinct(np.concatenate(held))


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", PART):
            own = [spectrum(t).tobytes() for t in texts_of(part).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("hash"), pa.array(own, pa.binary())], ["lang", "hash", "spectrum"])


def sample(docs: DataFrame, most: int = SAMPLE) -> dict[str, list[np.ndarray]]:
    """Spectra of at most about `most` learnable texts, evenly from all languages, those with the lowest text hashes."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("hash", F.xxhash64("text"))
    # As many rows as there are languages reach the driver; the most frequent `most` languages are learnt.
    many = known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most).collect()
    if not many:
        return {}
    each = max(1, most // len(many))
    span = 1 << 64
    limit = {r["lang"]: min(span, span * each // max(r["n"], 1)) - (1 << 63) - 1 for r in many}
    within = F.lit(False)
    for lang, last in limit.items():
        within = within | ((F.col("lang") == lang) & (F.col("hash") <= F.lit(last).cast("long")))
    chosen = known.where(within).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    out: dict[str, list[tuple[int, np.ndarray]]] = {}
    for lang, hashed, data in chosen.mapInArrow(_spectra, "lang string, hash long, spectrum binary").collect():
        out.setdefault(lang, []).append((hashed, np.frombuffer(data, np.int32)))
    return {lang: [s for _, s in sorted(out[lang], key=lambda r: r[0])[:each] if len(s)] for lang in sorted(out)}


class Model:
    """langs, landmarks (n-grams of each), weights: landmarks by languages."""

    def __init__(self, langs: list[str], landmarks: list[np.ndarray], weights: np.ndarray) -> None:
        self.langs, self.landmarks, self.weights = langs, landmarks, weights

    def _presence(self) -> tuple[np.ndarray, np.ndarray]:
        """The landmarks' n-grams, numbered, and the presence matrix: n-grams by landmarks."""
        number = np.full(1 << BITS, -1, np.int32)
        used = np.unique(np.concatenate([*self.landmarks, np.zeros(0, np.int32)]))
        number[used] = np.arange(len(used))
        matrix = np.zeros((len(used), len(self.landmarks)), np.float32)
        for k, own in enumerate(self.landmarks):
            matrix[number[own], k] = 1 / np.sqrt(len(own))
        return number, matrix

    def kernel(self, spectra: list[np.ndarray], presence: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Kernel values of texts to all landmarks by batched matrix products."""
        number, matrix = presence
        out = np.zeros((len(spectra), matrix.shape[1]), np.float32)
        for a in range(0, len(spectra), ROWS):
            own = spectra[a : a + ROWS]
            batch = np.zeros((len(own), len(matrix)), np.float32)
            for row, grams in enumerate(own):
                held = number[grams]
                batch[row, held[held >= 0]] = 1 / np.sqrt(max(len(grams), 1))
            out[a : a + ROWS] = batch @ matrix
        return out

    def decide(self, spectra: list[np.ndarray]) -> np.ndarray:
        """Decision values, texts by languages."""
        kept = worker_cache("language")
        if kept.get("weights") is not self.weights:
            kept.clear()
            kept["weights"], kept["presence"] = self.weights, self._presence()
        return self.kernel(spectra, kept["presence"]) @ self.weights


def train(texts: dict[str, list[np.ndarray]], landmarks: int = LANDMARKS) -> Model:
    """One-versus-rest kernel ridge regression in the Nyström space of the landmarks."""
    langs = [lang for lang, own in texts.items() if own]
    each = max(1, landmarks // max(len(langs), 1))
    model = Model(langs, [s for lang in langs for s in texts[lang][:each]], np.zeros((0, len(langs))))
    if not langs:
        return model
    presence = model._presence()
    values, vectors = np.linalg.eigh(model.kernel(model.landmarks, presence).astype(np.float64))
    safe = values > 1e-6 * values[-1]  # equal landmarks span nothing of their own
    root = vectors[:, safe] / np.sqrt(values[safe])
    features = np.concatenate([model.kernel(texts[lang], presence).astype(np.float64) for lang in langs]) @ root
    own = np.repeat(np.arange(len(langs)), [len(texts[lang]) for lang in langs])
    weight = 1 / np.bincount(own)[own]  # each language counts the same
    wanted = np.where(own[:, None] == np.arange(len(langs)), 1.0, -1.0)
    inner = features.T @ (features * weight[:, None]) + RIDGE * np.eye(features.shape[1])
    model.weights = (root @ np.linalg.solve(inner, features.T @ (wanted * weight[:, None]))).astype(np.float32)
    return model


def fit(docs: DataFrame) -> Model:
    """The model from the rows that are not held out."""
    return train(sample(docs))


def _told(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                spectra = [spectrum(t) for t in texts_of(part).to_pylist()]
                some = np.array([len(s) > 0 for s in spectra]) & bool(model.langs)
                langs, scores = np.full(len(spectra), UNKNOWN, object), np.zeros(len(spectra))
                if some.any():
                    values = SHARPNESS * model.decide([s for s, ok in zip(spectra, some, strict=True) if ok]).astype(np.float64)
                    best = values.argmax(1)
                    langs[some] = np.array(model.langs, object)[best]
                    scores[some] = 1 / np.exp(values - values[np.arange(len(best)), best][:, None]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    return run


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row; the text alone decides."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_told(model), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score by a model of the rows that are not held out."""
    return predicted(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
