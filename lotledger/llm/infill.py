"""Fill-in-middle by seekable compressed frames.

1. `framed` stores each text as independent zstandard frames of `FRAME_UNITS` code points, one behind the other in one blob, with the
   cumulative number of code points and of compressed bytes at the end of each frame. A frame can be read without those before it.
2. `arranged` cuts prefix, middle and suffix out of the store. Only the frames that hold a cut are decompressed; the others move into the output
   as they are. The output is itself such a store: plain (the text), psm (`<P>`prefix`<S>`suffix`<M>`middle) or spm (`<S>`suffix`<P>`prefix`<M>`middle).
3. `restored` finds the marks in the output, frame by frame, and puts the parts back in their order, again moving whole frames.
4. `digests` streams ordered frames into hashes; a text is never whole in memory there.

The cuts are h1 % (n + 1) and h2 % (n + 1) for n code points, the form hangs on h3 and h4, all of them 32-bit groups of the sha256 of the seed, a
colon and doc_id. A text that holds a mark stays plain, so the first marks in an output are the ones set here.

Null text: empty. Empty text: plain, no output. Null doc_id: hashed as if it were an empty text. Both cuts may fall together (an empty middle) and
at either end. Repeated rows give repeated rows with equal outputs. An empty table gives an empty result. Only doc_id and text are read,
so other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotledger.llm.tables import ship, slices, stored, texts_of, worker_cache

ship(__name__)

FRAME_UNITS, LEVEL, BATCH_BYTES, SEED = 1 << 14, 3, 1 << 21, 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
PLAIN_FROM, SPM_BELOW = 90, 20  # percent of h3 that stay plain, percent of h4 that put the suffix first

STORE = "frames binary, units array<long>, places array<long>"


def _zstd() -> dict:
    """Compressor and decompressor of this worker; making them anew costs more than a short text."""
    kept = worker_cache("zstd")
    if not kept:
        kept["pack"], kept["unpack"] = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    return kept


class Frames:
    """A text as independent frames. units, places: code points and compressed bytes up to the end of each."""

    def __init__(self, blob: bytes = b"", units: list[int] | None = None, places: list[int] | None = None) -> None:
        self.parts = [blob] if blob else []
        self.units, self.places = list(units or ()), list(places or ())

    @property
    def n(self) -> int:
        return self.units[-1] if self.units else 0

    @property
    def blob(self) -> bytes:
        if len(self.parts) > 1:
            self.parts = [b"".join(self.parts)]
        return self.parts[0] if self.parts else b""

    def _add(self, frame: bytes, n: int) -> None:
        self.parts.append(frame)
        self.units.append(self.n + n)
        self.places.append((self.places[-1] if self.places else 0) + len(frame))

    def write(self, text: str) -> None:
        """Append a text as new frames."""
        for a in range(0, len(text), FRAME_UNITS):
            own = text[a : a + FRAME_UNITS]
            self._add(_zstd()["pack"].compress(own.encode()), len(own))

    def frame(self, k: int) -> bytes:
        """The k-th frame as it is stored."""
        return self.blob[self.places[k - 1] if k else 0 : self.places[k]]

    def data(self, k: int) -> bytes:
        """The UTF-8 bytes of the k-th frame."""
        return _zstd()["unpack"].decompress(self.frame(k))

    def stream(self) -> Iterator[bytes]:
        for k in range(len(self.units)):
            yield self.data(k)

    def take(self, source: Frames, first: int, last: int, mark: str = "") -> None:
        """Append a mark and the code points first to last of a store. Whole frames move as they are; only those with a cut inside are decompressed."""
        held = mark
        k = bisect.bisect_right(source.units, first) if first < last else len(source.units)
        while k < len(source.units) and (before := source.units[k - 1] if k else 0) < last:
            after = source.units[k]
            if first <= before and after <= last:
                self.write(held)
                held = ""
                self._add(source.frame(k), after - before)
            else:
                held += source.data(k).decode()[max(first - before, 0) : last - before]
            k += 1
        self.write(held)


def _rows(stores: list[Frames]) -> list[pa.Array]:
    return [
        pa.array([s.blob for s in stores], pa.binary()), pa.array([s.units for s in stores], pa.list_(pa.int64())),
        pa.array([s.places for s in stores], pa.list_(pa.int64())),
    ]


def _stores(batch: pa.RecordBatch) -> Iterator[Frames]:
    for blob, units, places in zip(*(batch.column(c) for c in ("frames", "units", "places")), strict=True):
        yield Frames(blob.as_py(), units.as_py(), places.as_py())


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", BATCH_BYTES):
            stores = []
            for text in texts_of(part):
                stores.append(Frames())
                stores[-1].write(text.as_py())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([s.n for s in stores], pa.int64()), part.column("marked"), *_rows(stores)],
                ["doc_id", "n", "marked", "frames", "units", "places"],
            )


def framed(docs: DataFrame) -> DataFrame:
    """doc_id, n (code points), marked (the text holds a mark), frames, units, places: one row for each row of docs."""
    text = F.col("text")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(marked, F.lit(False)).alias("marked"))
    return rows.mapInArrow(_framed, f"doc_id long, n long, marked boolean, {STORE}")


def _group(k: int, seed: int) -> Column:
    """The k-th 8-digit group of the hash of a document, as a number."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(told, 8 * k - 7, 8), 16, 10).cast("long")


def planned(store: DataFrame, seed: int = SEED) -> DataFrame:
    """The store with form, first and second: the ends of prefix and middle in code points (null where the form is plain)."""
    n = F.col("n") + 1
    one, two = F.pmod(_group(1, seed), n), F.pmod(_group(2, seed), n)
    plain = (F.col("n") == 0) | F.col("marked") | (_group(3, seed) % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(_group(4, seed) % 100 < SPM_BELOW, "spm").otherwise("psm")
    return store.withColumns({"form": form, "first": F.when(~plain, F.least(one, two)), "second": F.when(~plain, F.greatest(one, two))})


def arrange(source: Frames, form: str, first: int | None, second: int | None) -> Frames:
    """The output of one text as a store of its own."""
    if form == "plain":
        return source
    out = Frames()
    if form == "psm":
        out.take(source, 0, first, PREFIX)
        out.take(source, second, source.n, SUFFIX)
    else:
        out.take(source, second, source.n, SUFFIX)
        out.take(source, 0, first, PREFIX)
    out.take(source, first, second, MIDDLE)
    return out


def _places_of(output: Frames, marks: list[str]) -> list[int]:
    """The code point at which the first of each mark begins; marks follow each other in this order and may lie across two frames."""
    found, held, at = [], "", 0  # at: code points before held
    for data in output.stream():
        held += data.decode()
        while len(found) < len(marks) and (i := held.find(marks[len(found)])) >= 0:
            found.append(at + i)
            at += i + 3
            held = held[i + 3 :]
        if len(found) == len(marks):
            break
        cut = max(len(held) - 2, 0)  # a mark may go on in the next frame
        at += cut
        held = held[cut:]
    return found


def restore(output: Frames, form: str) -> Frames:
    """The exact text from an output and its form."""
    if form == "plain":
        return output
    one, two, three = _places_of(output, [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE])
    parts = [(one + 3, two), (two + 3, three), (three + 3, output.n)]
    text = Frames()
    for k in (0, 2, 1) if form == "psm" else (1, 2, 0):
        text.take(output, *parts[k])
    return text


def _arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = (batch.column(c).to_pylist() for c in ("form", "first", "second"))
        outputs = [arrange(store, *row) for store, *row in zip(_stores(batch), *told, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "n", "form", "first", "second")), *_rows(outputs)],
            ["doc_id", "n", "form", "first", "second", "frames", "units", "places"],
        )


def arranged(plan: DataFrame) -> DataFrame:
    """doc_id, n, form, first, second and the output of each row as frames, units, places."""
    return plan.mapInArrow(_arranged, f"doc_id long, n long, form string, first long, second long, {STORE}")


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [restore(store, form) for store, form in zip(_stores(batch), batch.column("form").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_rows(texts)], ["doc_id", "frames", "units", "places"])


def restored(outputs: DataFrame) -> DataFrame:
    """doc_id and the exact text of each output as frames, units, places."""
    return outputs.select("doc_id", "form", "frames", "units", "places").mapInArrow(_restored, f"doc_id long, {STORE}")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [b"".join(s.stream()).decode() for s in _stores(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def texts(store: DataFrame) -> DataFrame:
    """doc_id, text of any store of frames."""
    return store.select("doc_id", "frames", "units", "places").mapInArrow(_texts, "doc_id long, text string")


def _sha256(store: Frames) -> str:
    told = hashlib.sha256()
    for data in store.stream():
        told.update(data)
    return told.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [(_sha256(s), _sha256(restore(s, form))) for s, form in zip(_stores(batch), batch.column("form").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "n", "form", "first", "second")), *(pa.array([t[k] for t in told], pa.string()) for k in range(2))],
            ["doc_id", "n", "form", "first", "second", "output_sha256", "restored_sha256"],
        )


def digests(outputs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of what `arranged` gives."""
    told = outputs.mapInArrow(_digests, "doc_id long, n long, form string, first long, second long, output_sha256 string, restored_sha256 string")
    lengths = [F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars")]
    return told.select("doc_id", "n", "form", *lengths, "output_sha256", "restored_sha256")


def transformed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The outputs of all rows of docs, out of a stored table of frames."""
    return arranged(planned(stored(framed(docs), "frames"), seed))
