"""Near copies by bottom-k sketches of one hash function.

A document's set holds its distinct 5-word shingles (A-Z in lower case; with fewer words: the whole sequence). Documents are
linked where 100 * intersection >= percent * union (85 unless the caller says otherwise); the operator gives the connected components.

1. Sketch: the `K` smallest hashes of the set. Documents with one and the same set are one class from here on.
2. Inverted lists of the retained values. Linked classes share `fewest` of 64 sketch values or more (half of them at 85 %, 30 at
   80 %; the chance of less is under 1e-9 for a pair right at the threshold), so each class is looked up by its rarest values
   only, as many as can't all be missed then. Values of a passage that very many documents hold are hardly ever among them.
3. Each list links its members to its centre, the one that shares most of its values, not to each other. Candidates pass the
   estimate from the union sketch, then the exact test on full sets.
4. Where members of a list are left in several components, they are searched without loss. Those at least half like the centre c are told by
   their differences D = x ^ c: |x ^ y| = |D_x ^ D_y|, and two sets that are linked but not both linked with c have differences in common, as
   many as sizes and threshold demand. Hubs first: each difference pairs its holders with the one of them that has fewest, so a group of n
   copies costs about n pairs. What is still apart then meets by its rarest differences, positions and sizes. Members less like their
   centre meet by the rarest shingles of full sets in the same way.
5. Components by star contraction.

Null or empty texts, and texts without words: empty set, linked with nothing, kept. Null doc_id: a document of its own that
is never the smallest of a component that has an id; a component without any id has a null component_id. Repeated rows are documents with the same
component. An empty table gives an empty result. Other columns are not read. Ties cannot occur: component_id is the smallest doc_id.
`without_copies` keeps one row of each component: smallest doc_id (null last), then text hash; of equal rows any one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotledger.llm.components import connected
from lotledger.llm.tables import ship, slices, stored, texts_of
from lotledger.llm.words import sequence_hashes, window_hashes, word_hashes

ship(__name__)

WORDS, K, PERCENT = 5, 64, 85
NEAR, NEAR_VALUES = 50, 12  # percent of likeness to a centre; so many of K values such a pair has but for a chance of 1e-7


def fewest(percent: int) -> int:
    """So many of the K values of a union sketch, at most half, that a pair right at the threshold has less with a chance under 1e-9."""
    p, missed = percent / 100, 0.0
    for n in range(K // 2):
        missed += math.comb(K, n) * p**n * (1 - p) ** (K - n)
        if missed >= 1e-9:
            return n
    return K // 2


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted 63-bit hashes of each text's set."""
    hashes, counts = word_hashes(texts, lower=True)
    windows, _, number = window_hashes(hashes, counts, words)
    short = np.flatnonzero((counts > 0) & (counts < words))
    ends = np.cumsum(counts)
    whole = sequence_hashes(hashes, ends[short] - counts[short], ends[short])
    stops = np.cumsum(number)
    sets = [np.unique(windows[a:b] >> np.uint64(1)) for a, b in zip((stops - number).tolist(), stops.tolist(), strict=True)]
    for row, value in zip(short.tolist(), whole >> np.uint64(1), strict=True):
        sets[row] = np.array([value])
    return sets


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            sets = shingle_sets(texts_of(part))
            low = [s[:K] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in low])])
            sketch = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(low).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), sketch, part.column("text_hash")],
                ["doc_id", "n_shingles", "digest", "sketch", "text_hash"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, sketch: its smallest hashes ascending, text_hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, sketch array<long>, text_hash long")


def inverted_lists(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """value, node, core: the rarest retained values of each class, those no other class has left out. core: the share of values others have."""
    size = F.size("sketch")
    postings = classes.select("node", size.alias("size"), F.explode("sketch").alias("value"))
    common = postings.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("node")
    ranked = postings.join(common, "value").select(
        "value", "node", "size",
        F.row_number().over(own.orderBy("n", "value")).alias("place"),
        F.count("*").over(own).alias("shared"),
    )
    few = F.col("place") <= F.col("shared") - F.ceil(F.col("size") * fewest(percent) / K) + 1
    return ranked.where(few).select("value", "node", (F.col("shared") / F.col("size")).alias("core"))


def likely(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT, values: int | None = None) -> DataFrame:
    """The pairs (a, b) that share `values` of K values of the union sketch or more (default: `fewest`), and whose sizes allow a link."""
    values = fewest(percent) if values is None else values
    known = classes.select("node", F.col("n_shingles").alias("n"), "sketch")

    def side(name: str) -> DataFrame:
        return known.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), "u"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (
        pairs.join(side("a"), "a").join(side("b"), "b").where(100 * small >= percent * large)
        .withColumn("u", union).where(K * shared >= values * F.size("u")).select("a", "b")
    )


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the wanted set; a doc_id alone may stand for several texts."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            sets = shingle_sets(texts_of(part))
            fits = pa.array([_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield part.select(["node", "text"]).filter(fits)


def _both_sets(batch: pa.RecordBatch, kept: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The full sets of a and b, row by row; rows near each other with one and the same node reuse its set."""
    for row, nodes in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
        own = []
        for node, column in zip(nodes, ("text_a", "text_b"), strict=True):
            if node not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[node] = shingle_sets(batch.column(column).slice(row, 1))[0]
            own.append(kept[node])
        yield own[0], own[1]


def _linked(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact test on full sets."""
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            good = []
            for x, y in _both_sets(batch, kept):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _differences(percent: int) -> Callable:
    close = NEAR + 100 - percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sets b that are `NEAR` percent or more like their centre a: one row for each shingle that only one of both holds."""
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            rows, own = [], []
            for x, y in _both_sets(batch, kept):
                apart = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(apart)) // 2
                rows.append((len(y), len(apart), 100 * both >= close * (both + len(apart))))
                own.append(apart if 100 * both >= NEAR * (both + len(apart)) else apart[:0])
            row = np.repeat(np.arange(len(own)), [len(x) for x in own])
            told = [np.array([r[k] for r in rows], t)[row] for k, t in enumerate((np.int64, np.int64, bool))]
            values = np.concatenate([*own, np.zeros(0, np.uint64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(row)) for c in ("a", "b")), *map(pa.array, told), pa.array(values)], ["centre", "node", "n", "d", "close", "value"]
            )

    return run


class _Texts:
    """Texts of the classes that candidates ask for; documents are read once."""

    def __init__(self, docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> None:
        ids = classes.join(wanted, "node").select("node", "digest", F.col("least_id").alias("id"), "text_hash")
        text = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text", F.xxhash64("text").alias("own_hash"))
        same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
        own = ids.join(text, same).select("node", "digest", "text").mapInArrow(_own_text, "node long, text string")
        self.rows = stored(own.groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    def of_both(self, pairs: DataFrame) -> DataFrame:
        a = self.rows.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = self.rows.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")

    def linked(self, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
        return self.of_both(pairs).mapInArrow(_linked(percent), "a long, b long")

    def differences(self, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
        """centre, node, n, d, close, value for pairs (a: centre, b: node)."""
        return self.of_both(pairs).mapInArrow(_differences(percent), "centre long, node long, n long, d long, close boolean, value long")


NO_ID = (1 << 63) - 1


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _centred(lists: DataFrame) -> DataFrame:
    """centre, node: each list's members beside the one that shares most."""
    centre = lists.groupBy("value").agg(F.max(F.struct("core", "node")).alias("c")).select("value", F.col("c.node").alias("centre"))
    return lists.join(centre, "value").where("node <> centre").select("centre", "node").distinct()


def _stars(lists: DataFrame) -> DataFrame:
    """Each list's members paired with its centre."""
    return _centred(lists).select(*_ordered(F.col("node"), F.col("centre"))).distinct()


def _labelled(rows: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    told = labels.select(F.col("node").alias(node), F.col("label").alias(label))
    return rows.join(told, node, "left").withColumn(label, F.coalesce(label, node))


def _open(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys whose rows are of several components."""
    return rows.groupBy(*keys).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select(*keys)


def _may_link(percent: int, left: Column | None = None) -> Column:
    """Whether sets of n1 and n2 shingles, d1 and d2 of them differences, can be linked with at most `left` differences in common.

    They are linked where |D1 ^ D2| = d1 + d2 - 2 common is at most (100 - p) / (100 + p) (n1 + n2).
    """
    n1, n2, d1, d2 = (F.col(c) for c in ("n1", "n2", "d1", "d2"))
    common = F.least(d1, d2) if left is None else left
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * (d1 + d2 - 2 * common) <= (100 - percent) * (n1 + n2))


def _sides(rows: DataFrame, by: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    one, two = (rows.select(*by, *[F.col(c).alias(c + k) for c in columns]) for k in "12")
    return one, two


def _hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each difference pairs its holders with the one that has fewest differences, where that is of another component."""
    hub = rows.groupBy("centre", "value").agg(F.min(F.struct("d", "node", "label", "n")).alias("hub"))
    hub = hub.select("centre", "value", *[F.col(f"hub.{c}").alias(f"{c}2") for c in ("node", "label", "n", "d")])
    one = rows.select("centre", "value", *[F.col(c).alias(f"{c}1") for c in ("node", "label", "n", "d")])
    pairs = one.join(hub, ["centre", "value"]).where((F.col("label1") != F.col("label2")) & _may_link(percent))
    return pairs.select(*_ordered(F.col("node1"), F.col("node2"))).distinct()


def _difference_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of one centre in different components that a link is possible for, by prefix, size and position of their differences.

    d differences of a set of n shingles share d - (100 - p) / p n with those of a linked one, and 1 at least.
    """
    many = rows.groupBy("centre", "value").agg(F.count("*").alias("many")).where("many > 1")
    own = Window.partitionBy("centre", "node")
    ranked = rows.join(many, ["centre", "value"]).select(
        "centre", "node", "label", "n", "d", "value", F.row_number().over(own.orderBy("many", "value")).alias("place"), F.count("*").over(own).alias("shared"),
    )
    least = F.greatest(F.lit(1), F.ceil(F.col("d") - F.col("n") * (100 - percent) / percent))
    prefix = stored(ranked.where((F.col("shared") >= least) & (F.col("place") <= F.col("shared") - least + 1)).withColumn("after", F.col("shared") - F.col("place") + 1), "prefix")
    one, two = _sides(prefix, ["centre", "value"], ["node", "label", "n", "d", "after"])
    fits = (F.col("label1") < F.col("label2")) & _may_link(percent, F.least("after1", "after2"))
    return one.join(two, ["centre", "value"]).where(fits).select(*_ordered(F.col("node1"), F.col("node2"))).distinct()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each set."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            sets = shingle_sets(texts_of(part))
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("node").take(pa.array(row)), part.column("label").take(pa.array(row)), pa.array(sizes[row]), pa.array(np.concatenate(sets).astype(np.int64))],
                ["node", "label", "n", "value"],
            )


def _full_pairs(nodes: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of these nodes in different components that a link is possible for, by prefix, size and position of full sets.

    In the order from the rarest shingle on, linked sets of n and m shingles have a first common one among the first
    n - p n + 1 of either (p = percent / 100), and from there on enough shingles left for the intersection, p / (1 + p) (n + m).
    """
    rows = stored(texts.join(nodes, "node").select("node", "label", "text").mapInArrow(_members, "node long, label long, n long, value long"), "members")
    common = rows.groupBy("value").agg(F.count("*").alias("many"), F.min("label").alias("x"), F.max("label").alias("y")).where("many > 1")
    own = Window.partitionBy("node")
    ranked = rows.join(common, "value").select(
        "node", "label", "n", "value", (F.col("x") < F.col("y")).alias("open"),
        F.row_number().over(own.orderBy("many", "value")).alias("place"), F.count("*").over(own).alias("shared"),
    )
    least = F.ceil(F.col("n") * percent / 100)
    prefix = ranked.where("open").where((F.col("shared") >= least) & (F.col("place") <= F.col("shared") - least + 1))
    prefix = stored(prefix.select("node", "label", "n", "value", (F.col("shared") - F.col("place") + 1).alias("after")), "prefix")
    one, two = _sides(prefix, ["value"], ["node", "label", "n", "after"])
    small, large = F.least("n1", "n2"), F.greatest("n1", "n2")
    fits = (100 * small >= percent * large) & ((100 + percent) * F.least("after1", "after2") >= percent * (F.col("n1") + F.col("n2")))
    return one.join(two, "value").where((F.col("label1") < F.col("label2")) & fits).select(*_ordered(F.col("node1"), F.col("node2"))).distinct()


def further(lists: DataFrame, links: DataFrame, classes: DataFrame, texts: _Texts, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between members of one list that its star, whose links are given, has left in different components; not all inside a component.

    A linked pair whose two sets are both `NEAR` percent like the list's centre is found by differences. Of any other one set is less like it,
    and the other then not `close`, that is less like it than NEAR + 100 - percent (unlikeness is a metric): both are in the search of full sets.
    """
    labels = connected(links)
    members = _labelled(_labelled(_centred(lists), labels), labels, "centre", "own")
    both = members.select("centre", "label").union(members.select("centre", F.col("own").alias("label")))
    members = stored(members.join(_open(both, "centre"), "centre").select("centre", "node", "label"), "open")
    asked = likely(members.select(F.col("centre").alias("a"), F.col("node").alias("b")), classes, NEAR, NEAR_VALUES)
    apart = stored(texts.differences(asked, percent), "differences")

    def still(labels: DataFrame) -> DataFrame:
        told = _labelled(apart, labels)
        return stored(told.join(_open(told, "centre"), "centre"), "apart")

    hubs = stored(texts.linked(_hub_pairs(still(labels), percent), percent), "hub-links")
    labels = connected(links.union(hubs))
    rest = texts.linked(_difference_pairs(still(labels), percent), percent)
    close = apart.where("close").select("centre", "node").distinct()
    told = _labelled(members.join(close, ["centre", "node"], "left_anti").select("centre", "node"), labels)
    nodes = told.join(_open(told, "centre"), "centre").select("node", "label").distinct()
    far = texts.linked(likely(_full_pairs(nodes, texts.rows, percent), classes, percent), percent)
    return hubs.union(rest).union(far)


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, text_hash, label (one for each component, null for empty sets), component_id for every row of docs."""
    every = stored(sketches(docs), "sketches")
    classes = stored(
        every.where("n_shingles > 0").groupBy("digest")
        .agg(
            F.min("doc_id").alias("least_id"), F.min_by("text_hash", F.coalesce("doc_id", F.lit(NO_ID))).alias("text_hash"),
            F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    lists = stored(inverted_lists(classes, percent), "lists")
    stars = likely(_stars(lists), classes, percent)
    texts = _Texts(docs, classes, lists.select("node").distinct())
    links = stored(texts.linked(stars, percent), "linked")
    labels = connected(links.union(further(lists, links, classes, texts, percent)))
    ends = labels.join(classes.select("node", "least_id"), "node").select("label", "least_id")
    ends = ends.union(labels.select("label").distinct().join(classes.select(F.col("node").alias("label"), "least_id"), "label"))
    least = ends.groupBy("label").agg(F.min("least_id").alias("component_id"))
    members = (
        classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        .join(least, "label", "left").select("digest", "label", F.coalesce("component_id", "least_id").alias("component_id"))
    )
    out = every.select("doc_id", "n_shingles", "digest", "text_hash").join(members, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "text_hash", "label", component.alias("component_id"))


def near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row of docs. Links are similarities of `percent` or more."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return grouped(docs, percent).select("doc_id", "n_shingles", "component_id", kept, "text_hash")


def without_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all columns, that are kept: one of each component, and all without words."""
    told = stored(grouped(docs, percent).where("label is not null").select("label", "doc_id", "text_hash"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = told.groupBy("label").agg(F.min(place).alias("first"))
    rows = told.groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("many")).join(first, "label")
    rows = rows.withColumn("kept", (place == F.col("first")))
    rows = stored(
        rows.where(~F.col("kept") | (F.col("many") > 1))
        .groupBy(F.col("doc_id").alias("llm_doc_id"), F.col("text_hash").alias("llm_text_hash")).agg(F.max("kept").alias("llm_kept")),
        "gone",
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("llm_doc_id")) & (F.xxhash64("text") == F.col("llm_text_hash"))
    once = docs.join(rows.where("llm_kept").select("llm_doc_id", "llm_text_hash"), same, "left_semi")
    alone = docs.join(rows.select("llm_doc_id", "llm_text_hash"), same, "left_anti")
    return alone.unionByName(once.dropDuplicates(["doc_id", "text"]))
