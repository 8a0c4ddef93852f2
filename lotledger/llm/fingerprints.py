"""MinHash fingerprints of documents.

A fingerprint holds, for each of `PERMUTATIONS` universal hash functions (a x + b modulo 2^64, upper half), the smallest value
over the text's 5-word shingles (A-Z in lower case; with fewer words: the whole sequence), 16 bits of each, in hex. The likeness
of two fingerprints is the share of equal places and estimates the Jaccard similarity.

`near_pairs` joins bands of the signatures in Spark and verifies the Jaccard similarity on full sets; what a band's centre leaves open
is searched as in near_dedup.
`edited_and_next` compares every document with its edited text and with the next document, in ascending doc_id: documents are dealt
into ranges of ids, each range also gets the first document after it, and every range is read in order once.

Null text: empty. Texts without words have the empty fingerprint, alike among themselves and unlike all others. Null doc_id: before all ids.
Repeated ids follow each other by text. A single document is its own next one. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotledger.llm import near_dedup
from lotledger.llm.near_dedup import NO_ID, shingle_sets
from lotledger.llm.tables import ship, slices, stored, texts_of
from lotledger.llm.words import sequence_hashes, window_hashes, word_hashes

ship(__name__)

WORDS, PERMUTATIONS, SEED = 5, 128, 20240229
BANDS, ROWS = 32, 4
FIRST = -(1 << 63)


def signatures(texts: pa.Array) -> np.ndarray:
    """Minima under each permutation, one row for each text; all ones for texts without words."""
    hashes, counts = word_hashes(texts, lower=True)
    windows, _, number = window_hashes(hashes, counts, WORDS)
    ends = np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    out = np.full((len(counts), PERMUTATIONS), 0xFFFFFFFF, np.uint64)
    random = np.random.default_rng(SEED)
    factors = random.integers(0, 1 << 64, PERMUTATIONS, np.uint64) | np.uint64(1)
    terms = random.integers(0, 1 << 64, PERMUTATIONS, np.uint64)
    if len(short):
        whole = sequence_hashes(hashes, ends[short] - counts[short], ends[short]) >> np.uint64(32)
        out[short] = (whole[:, None] * factors + terms) >> np.uint64(32)
    full = np.flatnonzero(number)
    if len(full):
        x = windows >> np.uint64(32)
        begin = (np.cumsum(number) - number)[full]
        moved = np.empty_like(x)
        for j, (a, b) in enumerate(zip(factors, terms, strict=True)):
            np.multiply(x, a, out=moved)
            np.add(moved, b, out=moved)
            out[full, j] = np.minimum.reduceat(moved, begin) >> np.uint64(32)
    return out


def texts_as_hex(signature: np.ndarray) -> list[str]:
    """16 bits of each minimum as hex."""
    data = np.ascontiguousarray(signature.astype(">u2")).tobytes().hex()
    width = 4 * PERMUTATIONS
    return [data[i : i + width] for i in range(0, len(data), width)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row, of what the fingerprints hold."""
    none = np.uint64(0xFFFFFFFF)
    empty = (a == none).all(1) != (b == none).all(1)
    return np.where(empty, 0.0, ((a & np.uint64(0xFFFF)) == (b & np.uint64(0xFFFF))).mean(1))


def _compared(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Rows of the result. following: the text after each one; they are the same list, one later, but for the last."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    own = signatures(pa.array([*texts, following[-1]], pa.string()))
    changed = signatures(pa.array(edited, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(texts_as_hex(own[:-1]), pa.string()), pa.array(texts_as_hex(changed), pa.string()),
            pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in order; the rows after a range stand behind it, and only the first of them counts."""
    held: tuple | None = None  # the last row, which waits for the next one
    ids, texts, size = [], [], 0
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            columns = (part.column(c).to_pylist() for c in ("bucket", "after", "doc_id"))
            for bucket, after, doc_id, text in zip(*columns, texts_of(part).to_pylist(), strict=True):
                if held is not None and held[0] == bucket:
                    ids.append(held[1])
                    texts.append(held[2])
                    size += len(held[2])
                    if after or size >= 1 << 19:
                        yield _compared(ids, texts, [*texts[1:], text])
                        ids, texts, size = [], [], 0
                held = None if after else (bucket, doc_id, text)


def edited_and_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = F.coalesce("doc_id", F.lit(FIRST))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [k / (4 * parts) for k in range(1, 4 * parts)]
    # As many ids as there are ranges reach the driver.
    cuts = rows.agg(F.percentile_approx(place, wanted, 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c <= place))
    heads = rows.groupBy(bucket.alias("bucket")).agg(F.min(place).alias("head")).orderBy("bucket").collect()
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}
    earlier = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<long,int>")
    to = F.when(place.isin(list(before)), F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("after")), F.struct(F.try_element_at(earlier, place).alias("bucket"), F.lit(True).alias("after"))))
    dealt = rows.select("doc_id", "text", F.explode(to.otherwise(F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("after"))))).alias("to"))
    return (
        dealt.select("to.bucket", "to.after", "doc_id", "text").repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "after", place, "text")
        .mapInArrow(
            _in_order,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        )
    )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            own = signatures(texts_of(part))
            used = (own != np.uint64(0xFFFFFFFF)).any(1)
            keys = [
                [hashlib.blake2b(bytes([b]) + row[b * ROWS : (b + 1) * ROWS].tobytes(), digest_size=16).digest() for b in range(BANDS)]
                for row in own
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array(keys, pa.list_(pa.binary()))], ["node", "bands"]
            ).filter(pa.array(used))


def _verified(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likes = []
            for row in range(batch.num_rows):
                x, y = (shingle_sets(batch.column(c).slice(row, 1))[0] for c in ("text_a", "text_b"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                likes.append(both / max(len(x) + len(y) - both, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(likes, pa.float64())], ["a", "b", "jaccard"]
            ).filter(pc.greater_equal(pa.array(likes, pa.float64()), percent / 100))

    return run


def _band_lists(texts: DataFrame) -> DataFrame:
    """value, node, core: the band keys of each class that another class has too. core: how many of them."""
    keys = texts.mapInArrow(_bands, "node long, bands array<binary>").select("node", F.explode("bands").alias("value"))
    common = keys.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    return keys.join(common, "value").select("value", "node", F.count("*").over(Window.partitionBy("node")).alias("core"))


def near_pairs(docs: DataFrame, percent: int = 80) -> DataFrame:
    """a, b, jaccard: links that connect all texts which share a band and are similar by `percent` or more. a <= b, null ids are last.

    Texts with equal sets are one class, told by pairs of its smallest id with each other one (jaccard 1), and stand in the other pairs by
    that id. A band key links its classes to one of them; where it still holds several components, full sets are searched without loss.
    Not listed are further pairs inside a component. A class that has only null ids stands as null; of repeated pairs one is given.
    """
    every = stored(near_dedup.sketches(docs).where("n_shingles > 0"), "near-sketches")
    classes = stored(
        every.groupBy("digest")
        .agg(
            F.min("doc_id").alias("least_id"), F.min_by("text_hash", F.coalesce("doc_id", F.lit(NO_ID))).alias("text_hash"), F.count("*").alias("many"),
            F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "near-classes",
    )
    texts = near_dedup._Texts(docs, classes, classes.select("node"))
    one = texts.rows.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.rows.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(one, "a").join(two, "b").mapInArrow(_verified(percent), "a long, b long, jaccard double")

    lists = stored(_band_lists(texts.rows), "near-lists")
    stars = stored(near_dedup.likely(near_dedup._stars(lists), classes, percent), "near-stars")
    links = stored(verified(stars), "near-links")
    links = links.union(verified(near_dedup.further(lists, links.select("a", "b"), classes, texts, percent)))
    ids = classes.select("node", F.coalesce("least_id", F.lit(NO_ID)).alias("id"))
    ends = links.join(ids.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
    across = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    same = every.select("doc_id", "digest").join(classes.select("digest", "least_id", "many"), "digest").where(
        ~F.col("doc_id").eqNullSafe(F.col("least_id")) | (F.col("least_id").isNull() & (F.col("many") > 1))
    )
    inside = same.select(F.coalesce("least_id", F.lit(NO_ID)).alias("a"), F.coalesce("doc_id", F.lit(NO_ID)).alias("b"), F.lit(1.0).alias("jaccard"))
    return across.union(inside).distinct().select(F.nullif("a", F.lit(NO_ID)).alias("a"), F.nullif("b", F.lit(NO_ID)).alias("b"), "jaccard")
