"""Stupid-backoff scores of all documents under an n-gram model of the corpus.

With ``order`` 2, a word w after v scores c(vw) / c(v) if the pair stands at
least ``cutoff`` times in the corpus, else ``alpha`` times c(w) / N; a text's
first word scores c(w) / N. Higher orders begin with longer grams and back off
one word at a time. The logarithms are summed for each document.

1. A task turns the texts it reads into chunks of a bounded number of words,
   which are written: the documents' ids and lengths, and their words as places
   in a list of word hashes.
2. A chunk's distinct grams of all orders, with how often they stand in it, are
   dealt into buckets by their hash. A gram that stands everywhere is one entry
   of each chunk, so a hot key is combined before anything is shuffled.
3. A bucket is a part of the count table: its entries are summed, and every
   entry is joined with its sum.
4. The sums go back to their chunk, where all words of a document stand together:
   it is scored and summed there, and leaves as one row.

Rows and bytes follow the number of words, and no count, word or gram is ever
collected in the driver or told to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import Remembered, bound_batches, materialize

#: Words after which a chunk is closed; the document that reaches it is in it as a whole.
CHUNK_WORDS = 2_000_000
#: Buckets of grams at least, and the entries that one is meant to hold at most.
BUCKETS, BUCKET_GRAMS = 1024, 4_000_000
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)

_hashes = Remembered(xxhash.xxh3_64_intdigest)


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words, split at ASCII blanks, A-Z lower-cased."""
    words = text.lower().split() if text else ()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as four compressed planes of bytes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _restored(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest takes (1, 2, 4 or 8)."""
    most = int(values.max()) if len(values) else 0
    return values.astype(f"<u{next(b for b in (1, 2, 4, 8) if most < 1 << 8 * b)}").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // max(n, 1) or 1}").astype(np.int64)


CHUNKS = "chunk long, n long, ids binary, known binary, lengths binary, names binary, words binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk of documents."""
    context = TaskContext.get()
    chunk, ids, held, n = (context.partitionId() if context else 0) << 32, [], [], 0

    def closed() -> pa.RecordBatch:
        known = np.array([i is not None for i in ids], np.uint8)
        own = np.array([i or 0 for i in ids], "<i8")
        names, words, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        by = np.argsort(-count, kind="stable")  # frequent words get small numbers, which take less room
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        cols = [chunk, n, own.tobytes(), known.tobytes(), np.array([len(h) for h in held], "<i8").tobytes(), names[by].astype("<u8").tobytes(), _squeezed(place[words])]
        kinds = [pa.int64()] * 2 + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

    try:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, text in zip(part[0].to_pylist(), part[1].cast(pa.binary()).to_pylist(), strict=True):
                    held.append(word_hashes(text))
                    ids.append(doc_id)
                    n += len(held[-1])
                    if n >= CHUNK_WORDS or len(ids) >= CHUNK_WORDS:
                        yield closed()
                        chunk, ids, held, n = chunk + 1, [], [], 0
        if ids:
            yield closed()
    finally:
        _hashes.clear()


class _Grams:
    """The grams of a chunk: for each order the sorted distinct hashes with their counts, and where each word's gram is among them."""

    def __init__(self, lengths: bytes, names: bytes, words: bytes, order: int) -> None:
        self.lengths = np.frombuffer(lengths, "<i8")
        n = int(self.lengths.sum())
        own = np.frombuffer(names, "<u8")[_restored(words, n)]
        self.at = np.arange(n) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.distinct, self.counts, self.places = [], [], []
        gram = own
        for k in range(1, order + 1):
            if k > 1:  # the gram of k words that end here is that of k - 1 words that end before, and this word
                gram = np.concatenate([own[:1], gram[:-1]]) * _MIX + own + np.uint64(k)
                gram ^= gram >> _HALF
                gram *= _STEP
                gram ^= gram >> _HALF
            distinct, place, count = np.unique(gram[self.at >= k - 1], return_inverse=True, return_counts=True)
            self.distinct.append(distinct)
            self.counts.append(count)
            self.places.append(place)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """All grams in order of their hash (equal ones of different orders one after the other), and where each order's went."""
        every = np.concatenate(self.distinct)
        by = np.argsort(every, kind="stable")
        return every[by], by


def _bounds(grams: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits buckets begins and ends among sorted hashes."""
    return np.searchsorted(grams >> np.uint64(64 - bits) if bits else grams * np.uint64(0), np.arange((1 << bits) + 1, dtype=np.uint64))


def _lower(grams: np.ndarray, bits: int) -> bytes:
    """The bytes of hashes without those that all hashes of a bucket share."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - bits // 8].tobytes()


def _raised(data: bytes, bits: int) -> np.ndarray:
    width = 8 - bits // 8
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


ASKED = "bucket int, chunk long, grams binary, counts binary"


def _asked(order: int, bits: int):
    """A chunk's grams and their counts, a row for each bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, lengths, names, words = (batch[c][i].as_py() for c in ("chunk", "lengths", "names", "words"))
                own = _Grams(lengths, names, words, order)
                grams, by = own.merged()
                counts = np.concatenate(own.counts)[by]
                bounds = _bounds(grams, bits)
                full = np.flatnonzero(bounds[1:] > bounds[:-1])
                for at in range(0, len(full), 256):
                    some = full[at : at + 256]
                    slices = [slice(bounds[b], bounds[b + 1]) for b in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some.astype(np.int32)),
                            pa.array(np.full(len(some), chunk)),
                            pa.array([_lower(grams[s], bits) for s in slices], pa.binary()),
                            pa.array([_narrow(counts[s]) for s in slices], pa.binary()),
                        ],
                        ["bucket", "chunk", "grams", "counts"],
                    )

    return run


ANSWERED = "chunk long, bucket int, totals binary"


def _answered(bits: int):
    """From rows sorted by bucket: the grams' counts in the corpus, in the order of each row's grams."""

    def totals(held: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        each = [_raised(row[2], bits) for row in held]
        sizes = [len(grams) for grams in each]
        counts = np.concatenate([_wide(row[3], n) for row, n in zip(held, sizes, strict=True)])
        _, place = np.unique(np.concatenate(each), return_inverse=True)
        found = np.bincount(place, weights=counts)[place].astype(np.int64)  # exact up to 2**53
        parts = np.split(found, np.cumsum(sizes)[:-1])
        return pa.RecordBatch.from_arrays(
            [pa.array([row[1] for row in held]), pa.array([row[0] for row in held], pa.int32()), pa.array([_narrow(p) for p in parts], pa.binary())],
            ["chunk", "bucket", "totals"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, bytes]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield totals(held)
                    held = []
                held.append(row)
        if held:
            yield totals(held)

    return run


SCORED = "id long, n_words long, n_known long, log_score double"


def _scored(order: int, bits: int, cutoff: int, alpha: float, total: int):
    """The scores of a chunk's documents from its words and the answers to its grams."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for i in range(chunks.num_rows):
            ids, known, lengths, names, words = (chunks[c][i].as_py() for c in ("ids", "known", "lengths", "names", "words"))
            own = _Grams(lengths, names, words, order)
            grams, by = own.merged()
            sizes = np.diff(_bounds(grams, bits))
            found = np.zeros(len(grams), np.int64)
            ends = np.cumsum(sizes)
            for bucket, data in zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist(), strict=True):
                found[ends[bucket] - sizes[bucket] : ends[bucket]] = _wide(data, int(sizes[bucket]))
            every = np.empty(len(grams), np.int64)
            every[by] = found
            of_order = np.split(every, np.cumsum([len(d) for d in own.distinct])[:-1])
            score, hit, before = np.zeros(len(own.at)), np.zeros(len(own.at), bool), None
            for k in range(1, order + 1):
                here = np.flatnonzero(own.at >= k - 1)
                count = np.zeros(len(own.at), np.int64)
                count[here] = of_order[k - 1][own.places[k - 1]]
                if k == 1:
                    score = np.log(np.maximum(count, 1)) - np.log(max(total, 1))
                else:
                    enough = count[here] >= cutoff
                    longer = np.log(np.maximum(count[here], 1)) - np.log(np.maximum(before[here - 1], 1))
                    score[here] = np.where(enough, longer, np.log(alpha) + score[here])
                if k == order:
                    hit[here] = count[here] >= cutoff
                before = count
            doc = np.repeat(np.arange(len(own.lengths)), own.lengths)
            rows.append(
                pa.table(
                    {
                        "id": pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(known, np.uint8) == 0),
                        "n_words": own.lengths,
                        "n_known": np.bincount(doc, weights=hit, minlength=len(own.lengths)).astype(np.int64),
                        "log_score": np.bincount(doc, weights=score, minlength=len(own.lengths)).astype(np.float64),
                    }
                )
            )
        schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_known", pa.int64()), ("log_score", pa.float64())])
        return pa.concat_tables(rows) if rows else schema.empty_table()

    return run


def score_documents(
    docs: DataFrame, order: int = 2, cutoff: int = 2, alpha: float = 0.4, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The stupid-backoff score of every document under the counts of all documents.

    Returns a row for each row of ``docs``: the id (a whole number), ``n_words``,
    ``n_known`` (words that end a gram of the full ``order`` at or over
    ``cutoff``) and ``log_score`` (natural logarithm, the sum over the words; 0
    for a text without words).

    * Null and empty texts have no words. Repeated rows are counted each, and get
      the same score. Counts tie without effect: no order among grams is used.
    * Null ids are allowed. Other columns are not read, whatever their names. An
      empty table gives an empty table.
    * A text of any length is counted whole; one of more than CHUNK_WORDS words is
      a chunk of its own, so a task holds the longest text (16 bytes a word).

    ``buckets`` (by default as many as the corpus needs, a power of two) decides
    how the count table is split and no result. Words and grams are told apart by 64-bit hashes.
    """
    if order < 1:
        raise ValueError("order is at least 1")
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chunks = materialize(read.mapInArrow(_chunks, CHUNKS), "chunks")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    bits = ((buckets or max(BUCKETS, -(-total * order // BUCKET_GRAMS))) - 1).bit_length()
    asked = chunks.select("chunk", "lengths", "names", "words").mapInArrow(_asked(order, bits), ASKED)
    answered = asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_answered(bits), ANSWERED)
    scored = chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_scored(order, bits, cutoff, alpha, total), SCORED)
    return scored.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_known", "log_score")
