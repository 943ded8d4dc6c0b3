"""Benchmark items inside documents, by SimHash over item-sized windows.

Every item has a fingerprint of ``BITS`` bits, the signs of summed word codes, and so has
every window of as many words in a document. Fingerprints are cut into ``BLOCKS`` blocks:
two within ``RADIUS`` bits agree to ``BLOCK_RADIUS`` bits in at least one block, so looking
at blocks finds all of them. Candidates are then compared exactly, by the weighted (counted)
five-word shingles of window and item. A window that is 80 % like an item differs in so few
words that its fingerprint lies beyond the radius with a chance below one in a million.

Which items a window is compared with comes from an index of shingles. A window that is 80 %
like an item lacks at most a fifth of its shingles, so it has one of any set that weighs
more; each item is listed under such a set of its rarest shingles. Time then follows the
items that share rare shingles with a document, not the number of items. At this radius an
index of the blocks alone would pass a quarter of all items to every window.

Items are taken in blocks of ``ITEM_BYTES`` of text, of which the driver holds one at a time and
the tasks get one each; documents are read once per block, where they are, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import settle, steps, table

BITS, BLOCKS, BLOCK_RADIUS = 128, 8, 4
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Text of the items that are looked for in one reading of the documents.
ITEM_BYTES = 32 << 20
_REGION_WORDS = 1 << 14
_FILTER_BITS = 20


def _codes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each word."""
    salted = [words.mix(hashes ^ salt) for salt in words.numbered(BITS // 64, 8)]
    signs = np.stack(salted, axis=1).view(np.uint8)
    return (np.unpackbits(signs, axis=1).astype(np.int8) << 1) - 1


def fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words at ``starts``, as rows of 16-bit blocks."""
    out = np.empty((len(starts), BITS // 8), np.uint8)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + _REGION_WORDS)))
        low = starts[at]
        codes = _codes(hashes[low:starts[stop - 1] + size])
        sums = np.zeros((len(codes) + 1, BITS), np.int32)
        np.cumsum(codes, axis=0, dtype=np.int32, out=sums[1:])
        here = starts[at:stop] - low
        out[at:stop] = np.packbits(sums[here + size] > sums[here], axis=1)
        at = stop
    return out.view(np.uint16)


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    return words.windows(hashes, min(size, len(hashes))) if len(hashes) else hashes


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all, counting every shingle as often as it stands."""
    both, count = np.unique(np.concatenate([a, b]), return_counts=True)
    own = np.zeros(len(both), np.int64)
    values, times = np.unique(a, return_counts=True)
    own[np.searchsorted(both, values)] = times
    other = count - own
    return float(np.minimum(own, other).sum() / np.maximum(own, other).sum())


class Items:
    """One block of items, ready to be looked for."""

    def __init__(self, rows: list[tuple], shingle: int, percent: int) -> None:
        self.shingle, self.percent = shingle, percent
        self.ids, self.sets = [], []
        for item_id, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = words.split(data, np.array([0, len(data)]))
            hashes = words.hash_words(data, starts, ends, words.BYTES_LOWER)
            if len(hashes):
                self.ids.append(item_id)
                self.sets.append((hashes, _shingles(hashes, shingle)))
        self.prints = [fingerprints(hashes, np.zeros(1, np.int64), len(hashes))[0] for hashes, _ in self.sets]
        #: shingle length -> (sorted shingles, limits and list of the items under each, quick filter)
        self.seeds = {}
        for length in {min(len(hashes), shingle) for hashes, _ in self.sets}:
            pairs = self._rarest([n for n, (hashes, _) in enumerate(self.sets) if min(len(hashes), shingle) == length])
            values, first = np.unique(pairs[:, 0], return_index=True)
            room = np.zeros(1 << _FILTER_BITS, bool)
            room[values & np.uint64(len(room) - 1)] = True
            self.seeds[length] = (values, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64), room)

    def _rarest(self, members: list[int]) -> np.ndarray:
        """(shingle, item): for each item its rarest shingles, more of them than a like window lacks."""
        known, times = np.unique(np.concatenate([np.unique(self.sets[n][1]) for n in members]), return_counts=True)
        listed = []
        for n in members:
            own, weight = np.unique(self.sets[n][1], return_counts=True)
            order = np.lexsort((own, times[np.searchsorted(known, own)]))
            total = int(weight.sum())
            lacking = total + (-self.percent * total // 100)
            enough = int(np.searchsorted(np.cumsum(weight[order]), lacking, "right")) + 1
            listed.append(np.stack([own[order[:enough]], np.full(min(enough, len(own)), n, np.uint64)], axis=1))
        listed = np.concatenate(listed)
        return listed[np.lexsort((listed[:, 1], listed[:, 0]))]

    def _regions(self, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(text, item) -> places of shingles under which the item is listed."""
        found: dict[tuple[int, int], list[int]] = {}
        for length, (values, limits, items, room) in self.seeds.items():
            grams = words.windows(hashes, length)
            at = np.flatnonzero(room[grams & np.uint64(len(room) - 1)])
            slot = np.minimum(np.searchsorted(values, grams[at]), len(values) - 1)
            hit = values[slot] == grams[at]
            at, slot = at[hit], slot[hit]
            owner = np.searchsorted(first, at, "right") - 1
            inside = at + length <= first[owner + 1]
            for place, text, n in zip(at[inside].tolist(), owner[inside].tolist(), slot[inside].tolist()):
                for item in items[limits[n]:limits[n + 1]].tolist():
                    found.setdefault((text, item), []).append(place)
        return found

    def search(self, data: np.ndarray, limits: np.ndarray) -> Iterator[tuple]:
        """(text, item, first word, words, similarity) of the best window for each pair."""
        starts, ends, first = words.split(data, limits)
        hashes = words.hash_words(data, starts, ends, words.BYTES_LOWER)
        for (text, item), places in self._regions(hashes, first).items():
            own, size = hashes[first[text]:first[text + 1]], len(self.sets[item][0])
            length, grams = min(size, len(own)), min(size, self.shingle)
            mark = np.zeros(len(own) + 1, np.int64)
            for place in places:
                place -= first[text]
                mark[max(0, place - (length - grams))] += 1
                mark[min(place, len(own) - length) + 1] -= 1
            spots = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            spots = spots[spots <= len(own) - length]
            if len(own) < grams or not len(spots):
                continue
            apart = np.bitwise_count(fingerprints(own, spots, length) ^ self.prints[item])
            near = (apart <= BLOCK_RADIUS).any(axis=1)
            near[near] = apart[near].sum(axis=1) <= RADIUS
            best = self._best(own, spots[near], length, self.sets[item][1], grams)
            if best is not None:
                yield (text, self.ids[item], best[1], length, best[0])

    def _best(self, own, spots, length, wanted, grams):
        """Exact similarity of candidate windows, the likeliest first."""
        best = None
        if not len(spots):
            return None
        low = spots[0]
        here = words.windows(own[low:spots[-1] + length], grams)
        total = np.concatenate([[0], np.cumsum(np.isin(here, wanted))])
        count = length - grams + 1
        shared = total[spots - low + count] - total[spots - low]
        most = shared / np.maximum(1, count + len(wanted) - shared)
        for n in np.lexsort((spots, -most)).tolist():
            if 100 * most[n] < self.percent or (best is not None and most[n] <= best[0]):
                break
            like = similarity(here[spots[n] - low:spots[n] - low + count], wanted)
            if 100 * like >= self.percent - 1e-9 and (best is None or like > best[0]):
                best = (like, int(spots[n]))
        return best


def _find(items: Items):
    def run(batches):
        for batch, data, limits in words.chunks(batches, "text"):
            rows = list(items.search(data, limits))
            if not rows:
                continue
            text, item, start, size, like = (list(x) for x in zip(*rows))
            names = batch.schema.names
            at = pa.array(text, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("doc_id")).take(at),
                 batch.column(names.index("text_key")).take(at), pa.array(item, pa.int64()),
                 pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(like, pa.float64())],
                ["doc_id", "text_key", "item_id", "start_word", "n_words", "similarity"])
    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            shingle: int = 5, percent: int = 80, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """A row per document and item found in it: doc_id, text_key, item_id, start_word, n_words,
    similarity of the best window (the first of equals).

    Words are compared after lower-casing A-Z. A document shorter than an item is one window;
    an item of fewer than ``shingle`` words is one shingle. NULL, empty and blank texts match
    nothing; NULL ids are carried. Items with equal texts are found each. ``text_key`` is
    xxhash64 of the text, to tell rows with one doc_id apart. Empty tables give no rows.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                         F.xxhash64(F.col(text_column).cast("string")).alias("text_key"),
                         F.col(text_column).cast("string").alias("text"))
    schema = "doc_id long, text_key long, item_id long, start_word long, n_words long, similarity double"
    found = []
    with steps(docs.sparkSession) as keep:
        items = settle(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")))
        total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
        blocks = max(1, -(-total // item_bytes))
        share = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        for block in range(blocks):
            rows = [tuple(row) for row in items.where(share == block).collect()]
            found.append(keep(source.mapInArrow(_find(Items(rows, shingle, percent)), schema)))
    return reduce(DataFrame.union, found)


def without_matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item was found, all columns as they are."""
    hit = settle(matches(docs, benchmark, id_column, text_column).select(
        F.col("doc_id").alias("__found_id"), F.col("text_key").alias("__found_key")).distinct())
    return docs.join(hit.hint("merge"), F.col(id_column).cast("long").eqNullSafe(F.col("__found_id"))
                     & (F.xxhash64(F.col(text_column).cast("string")) == F.col("__found_key")), "left_anti")


def op8_decontamination(spark, folder: str) -> DataFrame:
    return matches(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_key")
