"""Operators on documents against brute force, over texts that are null, empty, long, repeated or odd."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lotledger.llm import bpe, fingerprints, katz, licenses, near_dedup, packing, substring_dedup, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(text):
    return (text or "").encode().split()


def shingles(text):
    own = words((text or "").encode().lower().decode())
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_bpe_is_tiktoken(docs, rows, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    vocabulary = (RANKS, public_tokenizers.PATTERN)
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got(bpe.digests(bpe.encode(docs, *vocabulary), *vocabulary), *columns) == sorted(want, key=str)
    assert bpe.digests(bpe.encode(nothing, *vocabulary), *vocabulary).count() == 0


def test_bpe_of_long_words():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for text in ("abcd" * 500, "a" * 3000, "thequickbrownfox" * 20, "ß" * 700):
        ids, offsets = codec.encode([text, "x"])
        assert ids[: offsets[1]].tolist() == own.encode_ordinary(text)
        assert codec.merged([text.encode()[:200]])[0].tolist() == codec.merged_long(text.encode()[:200]).tolist()


def test_bpe_keeps_each_word_once():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    texts = ["", "qwzxv qwzxv, it's  qwzxv\n12345", " ", "qwzxv", "qwzxv," * 3, "\n\n x", "\u00df" * 300 + " qwzxv"]
    for _ in range(2):
        ids, offsets = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [own.encode_ordinary(t) for t in texts]
    # A word is a number and a place among all ids, no array of its own; a piece that is one word has that place.
    assert sorted(codec.words.values()) == list(range(len(codec.words)))
    assert codec.starts[codec.chunk["qwzxv"]] == codec.word_starts[codec.words["qwzxv"]]


def test_near_copies(docs, rows, nothing):
    sets = [shingles(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = collections.defaultdict(list)
    for (i, *_), g in zip(rows, group, strict=True):
        if i is not None:
            least[g].append(i)
    want = []
    for (i, *_), s, g in zip(rows, sets, group, strict=True):
        component = min(least[g], default=None) if s else i
        want.append((i, len(s), component, i == component))
    found = near_dedup.near_copies(docs)
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)
    assert near_dedup.near_copies(nothing).count() == 0
    kept = near_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert got(kept, "doc_id") == sorted([(w[0],) for w in want if w[3]], key=str)


def test_open_groups(spark):
    """Members far from the centre of their lists but near each other are linked all the same."""
    core = [f"c{i}" for i in range(200)]
    texts = []
    for k in range(30):
        changed = list(core)
        for j in range(k % 6):
            changed[(37 * k + 31 * j) % 200] = f"e{k}x{j}"
        texts += [" ".join(changed), " ".join([*changed, f"t{k}"])]
    found = near_dedup.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    assert [tuple(r) for r in found.orderBy("doc_id").select("doc_id", "component_id").collect()] == list(enumerate(group))


def test_fingerprints(docs, rows, nothing):
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, likes = [], []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
        likes.append((i, text, edited, following))
    found = fingerprints.edited_and_next(docs)
    assert got(found, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=str)
    by_text = collections.defaultdict(set)
    rows_of = {(r["doc_id"], r["edited_sha256"]): r for r in found.collect()}
    for i, text, edited, following in likes:
        r = rows_of[i, hashlib.sha256(edited.encode()).hexdigest()]
        by_text[text].add(r["fingerprint"])
        for like, other in ((r["near_edited"], edited), (r["near_next"], following)):
            a, b = shingles(text), shingles(other)
            assert abs(like - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints.edited_and_next(nothing).count() == 0
    one = docs.sparkSession.createDataFrame([(4, "abcdef")], "doc_id long, text string")
    assert fingerprints.edited_and_next(one).first()["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def test_near_pairs(docs, nothing):
    pairs = {(r["a"], r["b"]) for r in fingerprints.near_pairs(docs).collect()}
    assert {(6, 15), (6, 18), (6, 100), (27, 30)} <= pairs and not any(a in (0, 3) for a, _ in pairs)
    assert fingerprints.near_pairs(nothing).count() == 0


def test_katz(docs, rows, nothing):
    texts = [(i, [*words((t or "").encode().lower().decode()), "end"]) for i, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts]
    single, pairs = collections.Counter(), collections.defaultdict(collections.Counter)
    for (_, own), h in zip(texts, held, strict=True):
        if not h:
            single.update(own)
            for a, b in zip(["begin", *own], own, strict=False):
                pairs[a][b] += 1

    def many(counts):
        return [sum(c == r for c in counts) for r in range(1, katz.MOST + 2)]

    total = sum(single.values())
    model = katz.Unigrams([len(single), total, *many(single.values())])
    kept = katz.discounts(many([c for h in pairs.values() for c in h.values()]))

    def unigram(word):
        return float(model(np.array([single[word]]))[0])

    def chance(history, word):
        if history not in pairs:
            return unigram(word)
        seen, size = pairs[history], sum(pairs[history].values())
        share = {w: kept[min(c, katz.MOST + 1)] * c / size for w, c in seen.items()}
        if all(c > katz.MOST for c in seen.values()):
            share = {w: c / (size + 1) for w, c in seen.items()}
        return share[word] if word in share else (1 - sum(share.values())) / (1 - sum(unigram(w) for w in seen)) * unigram(word)

    assert math.isclose(sum(unigram(w) for w in single) + model.unknown, 1)
    for history in list(pairs)[:20]:
        assert math.isclose(sum(chance(history, w) for w in single) + chance(history, "never seen"), 1, rel_tol=1e-9)
    want = {}
    for (i, own), h in zip(texts, held, strict=True):
        base = sum(math.log10((single[w] + 0.1) / (total + 0.1 * (len(single) + 1))) for w in own)
        score = sum(math.log10(chance(a, b)) for a, b in zip(["begin", *own], own, strict=False))
        want.setdefault((i, len(own)), (h, sum(w in single for w in own), total, base, score))
    found = katz.score(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        h, known, train, base, score = want[r["doc_id"], r["n_tokens"]]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (h, known, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-6)
    assert katz.score(nothing).count() == 0


def test_katz_with_hot_histories_dealt_out(docs, monkeypatch):
    want = got(katz.score(docs).selectExpr("doc_id", "n_tokens", "round(score, 6) score"), "doc_id", "n_tokens", "score")
    monkeypatch.setattr(katz, "SHARD", 64)
    assert got(katz.score(docs).selectExpr("doc_id", "n_tokens", "round(score, 6) score"), "doc_id", "n_tokens", "score") == want


def removed(rows, size=13):
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, text, *_ in rows:
        own = words(text)
        for p in range(len(own) - size + 1):
            w = tuple(own[p : p + size])
            first[w] = min(first.get(w, math.inf), key(i))
    for i, text, *_ in rows:
        own = words(text)
        gone = [False] * len(own)
        for p in range(len(own) - size + 1):
            if first[tuple(own[p : p + size])] < key(i):
                gone[p : p + size] = [True] * size
        kept = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
        yield i, len(own), sum(gone), kept


def test_substring_dedup(docs, rows, nothing):
    want = [(i, n, m, hashlib.sha256(kept).hexdigest()) for i, n, m, kept in removed(rows)]
    assert got(substring_dedup.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)
    assert substring_dedup.digests(nothing).count() == 0
    new = substring_dedup.without_repeats(docs)
    assert new.columns == docs.columns
    texts = [(i, kept.decode() if m else text) for (i, _, m, kept), (_, text, *_) in zip(removed(rows), rows, strict=True)]
    assert got(new, "doc_id", "text") == sorted(texts, key=str)
    assert all(n == (None if t is None else len(t)) for t, n in got(new, "text", "n_chars"))


def test_packing(docs, rows, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            own = ids[p : p + 2048]
            want.append((i, p // 2048, p, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    found = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).cache()
    assert got(found, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    places = collections.defaultdict(list)
    for r in found.collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_plan_fills_exactly():
    fillings = packing.plan({5: 4, 3: 4, 2: 5, 7: 1, 10: 2, 1: 1}, 10)
    used = collections.Counter()
    for filling, n in fillings:
        assert sum(filling) <= 10
        for x in filling:
            used[x] += n
    assert used == {5: 4, 3: 4, 2: 5, 7: 1, 10: 2, 1: 1}
    assert sum(n for _, n in fillings) == math.ceil((5 * 4 + 3 * 4 + 2 * 5 + 7 + 20 + 1) / 10)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, 60)) for _ in range(600)]
    toxic = [k % 5 == 0 for k in range(600)]
    texts = [t + " Idiot, go" if x else t for t, x in zip(texts, toxic, strict=True)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(None, None, "en"), (700, "", "de")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(k, 1, int(x)) for k, x in enumerate(toxic) if k % 2] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels, toxic


def test_toxicity(labelled, spark):
    docs, labels, toxic = labelled
    found = toxicity.scored(docs, toxicity.fit(docs, labels))
    assert found.columns == [*docs.columns, toxicity.SCORE] and found.count() == 602
    scores = {r["doc_id"]: r[toxicity.SCORE] for r in found.collect()}
    right = [(scores[k] >= 0.5) == x for k, x in enumerate(toxic) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean(right) > 0.95 and all(0 <= s <= 1 for s in scores.values()) and scores[700] < 0.5
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    none = toxicity.scored(docs, toxicity.fit(docs, labels.limit(0)))
    assert {r[toxicity.SCORE] for r in none.collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_licences(spark):
    files = [
        (1, "a/LICENSE", "Some name.\nReleased under the MIT License."), (2, "a/x.txt", "nothing here"), (3, "a/b/c/y.txt", None),
        (4, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (5, "z/q.txt", "no licence at all"), (6, None, ""),
        (7, "a/b/own.txt", "text before. This work is licensed under the GNU General Public License, version 3. And after."), (7, "z/LICENSE", "Hello."),
        (8, "top.txt", "The license of the work is under discussion in the general public of the land"),
    ]
    found = licenses.scan(spark.createDataFrame(files, "file long, path string, text string"))
    told = {(r["file"], r["path"]): (r["licence"], r["how"], r["from_path"]) for r in found.collect()}
    assert len(told) == len(files)
    assert told[2, "a/x.txt"] == ("MIT", "inherited", "a/LICENSE") and told[3, "a/b/c/y.txt"] == ("Apache-2.0", "inherited", "a/b/LICENSE")
    assert told[7, "a/b/own.txt"] == ("GPL-3.0", "own", "a/b/own.txt") and told[4, "a/b/LICENSE"][0] == "Apache-2.0"
    assert all(told[k] == (None, None, None) for k in [(5, "z/q.txt"), (6, None), (7, "z/LICENSE"), (8, "top.txt")])
    assert licenses.scan(spark.createDataFrame([], "file long, path string, text string")).count() == 0


def test_toxicity_of_odd_labels(labelled, spark):
    """Labels that differ count as toxic, a repeated doc_id is learnt from once, a very long text is scored whole, rows without words by the bias."""
    docs, labels, toxic = labelled
    long = " ".join(["v1 v2 v3"] * 40000) + " Idiot, go"
    more = docs.union(spark.createDataFrame([(801, long, "en"), (801, long, "en"), (802, " \n", "en")], docs.schema))
    both = labels.union(spark.createDataFrame([(k, 0, 0) for k, x in enumerate(toxic) if x and k % 2], labels.schema))
    found = toxicity.scored(more, toxicity.fit(more, both)).collect()
    scores = {r["doc_id"]: r[toxicity.SCORE] for r in found}
    assert len(found) == 605 and all(scores[k] >= 0.5 for k, x in enumerate(toxic) if x)
    assert scores[802] == scores[700] == scores[None] < 0.5
    assert toxicity.without_toxic(more, both).where("doc_id is null or doc_id in (700, 802)").count() == 3


def test_copies_count_as_one_text():
    rng = np.random.default_rng(1)
    texts = [np.unique(rng.integers(0, 1 << toxicity.BITS, 60)) for _ in range(20)]
    per = toxicity.shares([*texts, *[texts[0]] * 9, np.zeros(0, np.int64)])
    assert np.allclose(per[[0, *range(20, 29)]], 0.1) and np.allclose(per[1:20], 1)
