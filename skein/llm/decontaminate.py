"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size into powers of two of shingles. A document is searched, for each
partition, in overlapping windows of twice the partition's size, so that a short item inside a long document
is a large part of some window and its MinHash agrees there with high probability in some of the hash
functions. Windows of all partitions share the minima of their halves. Items that agree anywhere are
verified by the exact containment of their shingles in the whole document. Items of fewer shingles than the smallest
partition has are too small a part of its windows; their shingles are looked up one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import WordHashes, in_short_batches, lower_words, shingle_hashes
from skein.operators.work import discard, saved

#: Hash functions. An item is at least a fifth of some window (0.8 of it, just over half of its partition's
#: size, in a window of twice that), so it is missed with probability 0.8 ** HASHES at most, 6e-7.
HASHES = 64
#: Shingles in the halves of the smallest partition.
LEAST = 8
#: Test items a block, and bytes of their texts (more only in one item): what is broadcast at once is bounded, however many and long
#: items are. A block's index has 8 bytes a shingle, 0.8 KB an item and 4 MB a size partition: some 150 MB at most.
BLOCK, BLOCK_BYTES = 10_000, 8 << 20
#: Words that are searched at once, more only in one document.
CHUNK = 60_000

_MULTIPLIERS = (np.random.default_rng(11).integers(1, 1 << 62, HASHES // 2, np.uint64) << np.uint64(1)) | np.uint64(1)


def _hashed(shingles: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    """Two 32-bit hashes of each shingle, the halves of one product: a row each."""
    product = shingles * multiplier
    return np.stack([(product >> np.uint64(32)).astype(np.uint32), product.astype(np.uint32)])


def _halved(minima: np.ndarray) -> np.ndarray:
    return np.minimum(minima[:, ::2], minima[:, 1::2])


def _minima(shingles: np.ndarray, docs: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, signatures, documents) of windows of two halves of that size, for the sizes LEAST, 2 * LEAST, ... most.

    shingles: of several documents, one after the other; docs: the document of each. Each document is padded to
    whole halves of the largest size, so that minima of all sizes come from halving; a window begins at every half, and the last
    of a document is a half only.
    """
    begin = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    lengths = np.diff(np.r_[begin, len(docs)])
    padded = -(-lengths // LEAST) * LEAST
    at = np.arange(len(docs)) + np.repeat(np.r_[0, np.cumsum(padded - lengths)[:-1]], lengths)
    half = np.empty((HASHES, int(padded.sum()) // LEAST), np.uint32)
    full = np.full((2, int(padded.sum())), 0xFFFFFFFF, np.uint32)
    for k, m in enumerate(_MULTIPLIERS):
        full[:, at] = _hashed(shingles, m)
        half[2 * k : 2 * k + 2] = _halved(_halved(_halved(full)))
    of, size = np.repeat(docs[begin], padded // LEAST), LEAST
    while True:
        window = half.copy()
        np.minimum(half[:, :-1], half[:, 1:], out=window[:, :-1], where=of[1:] == of[:-1])
        yield size, window, of
        if size >= most:
            return
        size *= 2
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        nth = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        even = np.flatnonzero(nth % 2 == 0)
        half, of = np.minimum.reduceat(half, even, axis=1), of[even]


class ItemIndex:
    """Signatures of a block of test items by size partition, for look-up, and their shingles, to verify."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int) -> None:
        hashes = WordHashes()
        self.width = width
        self.items: list[tuple[str | None, np.ndarray, int]] = []
        #: Of each partition: which upper halves of values occur, by hash function; the values, sorted, and the items that have them.
        self.sieves: dict[int, np.ndarray] = {}
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_size: dict[int, list[int]] = {}
        #: Items of fewer words than a shingle by their number of words: looked up whole.
        self.short: dict[int, dict[int, list[int]]] = {}
        #: Items of fewer than LEAST shingles by each of these.
        self.few: dict[int, list[int]] = {}
        for item_id, text in items:
            words = lower_words(text)
            s = np.unique(shingle_hashes(hashes.of(words), width))
            if not len(s):
                continue
            at = len(self.items)
            self.items.append((item_id, s, len(words)))
            if len(words) < width:
                self.short.setdefault(len(words), {}).setdefault(int(s[0]), []).append(at)
            elif len(s) < LEAST:
                for h in s.tolist():
                    self.few.setdefault(h, []).append(at)
            else:
                by_size.setdefault(max(LEAST, 1 << int(len(s) - 1).bit_length()), []).append(at)
        self.few_known = np.fromiter(self.few, np.uint64, len(self.few))
        with np.errstate(over="ignore"):
            for size, members in by_size.items():
                least = np.array([np.concatenate([_hashed(self.items[i][1], m).min(1) for m in _MULTIPLIERS]) for i in members])
                self.sieves[size] = np.zeros((HASHES, 1 << 16), bool)
                self.tables[size] = []
                for k in range(HASHES):
                    order = np.argsort(least[:, k], kind="stable")
                    self.tables[size].append((least[order, k], np.array(members)[order]))
                    self.sieves[size][k, least[:, k] >> 16] = True

    def candidates(self, hashed: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs to verify, from the word hashes of several documents."""
        found: set[tuple[int, int]] = set()
        words, docs = np.concatenate(hashed), np.repeat(np.arange(len(hashed)), [len(h) for h in hashed])
        for k, known in self.short.items():
            runs, whole = shingle_hashes(words, k), docs[: len(docs) - k + 1] == docs[k - 1 :]
            for at in np.flatnonzero(whole & np.isin(runs, np.fromiter(known, np.uint64, len(known)))) if len(words) >= k else ():
                found.update((int(docs[at]), item) for item in known[int(runs[at])])
        if (self.tables or self.few) and len(words) >= self.width:
            whole = docs[: len(docs) - self.width + 1] == docs[self.width - 1 :]
            shingles, docs = shingle_hashes(words, self.width)[whole], docs[: len(whole)][whole]
            if self.few:
                for at in np.flatnonzero(np.isin(shingles, self.few_known)):
                    found.update((int(docs[at]), item) for item in self.few[int(shingles[at])])
            if len(shingles) and self.tables:
                with np.errstate(over="ignore"):
                    for size, signatures, of in _minima(shingles, docs, max(self.tables)):
                        for k in range(HASHES if size in self.tables else 0):
                            own, (values, members) = signatures[k], self.tables[size][k]
                            near = np.flatnonzero(self.sieves[size][k][own >> 16])
                            left, right = np.searchsorted(values, own[near]), np.searchsorted(values, own[near], "right")
                            for w in np.flatnonzero(right > left):
                                found.update((int(of[near[w]]), item) for item in members[left[w] : right[w]].tolist())
        return found

    def search(self, texts: list[bytes | None], percent: int, hashes: WordHashes) -> Iterator[tuple[int, str | None, int, int]]:
        """(place of the text, item, shingles of the item, how many of them the text holds) for the items that texts contain."""
        at = 0
        while at < len(texts):
            hashed, n = [], 0
            while at + len(hashed) < len(texts) and n < CHUNK:
                hashed.append(hashes.of(lower_words(texts[at + len(hashed)])))
                n += len(hashed[-1])
            for doc, item in sorted(self.candidates(hashed)):
                item_id, s, n_words = self.items[item]
                held = len(s) if n_words < self.width else int(np.isin(s, shingle_hashes(hashed[doc], self.width)).sum())
                if 100 * held >= percent * len(s):
                    yield at + doc, item_id, len(s), held
            at += len(hashed)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row (doc_id, item_id, n_item, n_shared) per document and test item that it contains.

    A document contains an item if 100 * shared >= percent * item size, counted in distinct shingles of width
    words (A-Z lower-cased) of the whole texts. An item of fewer words is one shingle of its own length. Null and
    empty items are contained nowhere; null and empty documents contain nothing. Repeated documents and items
    give repeated rows, null ids rows with null ids; other columns are ignored. Items go out in blocks of BLOCK or BLOCK_BYTES. If
    there are several, the documents are read once for each and its finds written before the next goes out, so that
    an executor holds one block however many items there are.
    """
    docs = in_short_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    spark, schema = docs.sparkSession, "doc_id string, item_id string, n_item long, n_shared long"
    out = None
    for block, last in _blocks(items):
        sent = spark.sparkContext.broadcast(ItemIndex(block, width))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            hashes = WordHashes()
            for b in batches:
                ids = b["doc_id"].tolist()
                rows = [(ids[at], *r) for at, *r in sent.value.search(b["text"].tolist(), percent, hashes)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_item", "n_shared"])

        found = docs.mapInPandas(search, schema)
        if not last or out is not None:
            found = saved(found)
            sent.destroy()
        out = found if out is None else out.union(found)
    out = out if out is not None else spark.createDataFrame([], schema)
    return out.withColumns({c: F.col(c).cast("long") for c in ("doc_id", "item_id")})


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[str | None, bytes]], bool]]:
    """The test items in blocks of at most BLOCK and BLOCK_BYTES, one block in the driver at a time, each with whether it is the last."""
    block: list[tuple[str | None, bytes]] = []
    size = 0
    for row in items.toLocalIterator():
        text = bytes(row["text"] or b"")
        if block and (len(block) == BLOCK or size + len(text) > BLOCK_BYTES):
            yield block, False
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block, True


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all their columns, that contain no test item, by the rules of contaminated()."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    schema, first = in_short_batches(docs).schema, True
    for block, last in _blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, width))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                texts = b.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
                bad = {at for at, *_ in sent.value.search(texts, percent, hashes)}
                yield b.filter(pa.array([at not in bad for at in range(len(texts))], pa.bool_()))

        before, docs = docs, docs.mapInArrow(clean, schema)
        if not last:
            docs = saved(docs)
            sent.destroy()
            if not first:
                discard(before)
        first = False
    return docs
