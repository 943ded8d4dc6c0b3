"""Repeated passages across documents, by hashes of windows in prefix groups.

Only suffixes of at least ``min_words`` words matter, and of each only its first
``min_words`` words: a deeper repeat is a run of consecutive repeated windows. One pass
counts suffixes per hashed prefix of three words, a table of fixed size. Prefixes are laid
out in order: neighbours share a group until it is full, and a prefix that is too common
for one group is split by the hash of the window. Each group then fits one task, which
sorts the 64-bit hashes of its windows; hashes that several documents have are the repeats,
and every document but the least loses its window. No suffix tree is built. What groups find goes back to the chunk of text it came from, and from
there to its documents, so a document is not listed once per group.

Before suffixes are sent, a task drops those whose window it has already seen in a smaller
document: they are lost whatever other tasks hold. A passage in a third of all documents
is therefore sent once per chunk of text and cannot fill a group. Suffixes of one task and
group travel as one row of packed numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import settle, steps, table

#: Suffixes that one group holds at most (about 20 bytes each).
GROUP_SUFFIXES = 1_000_000
GROUPS_PER_TASK = 4
#: Bits of the first, second and third word in a prefix.
PREFIX_BITS = (6, 5, 5)
NULL_LAST = (1 << 63) - 1


def _suffixes(data: np.ndarray, limits: np.ndarray, size: int):
    """Word limits per text, and of every full window: its first word, its text, its hash."""
    starts, ends, first = words.split(data, limits)
    hashes = words.hash_words(data, starts, ends)
    counts = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = words.spread(counts)
    at = first[:-1][owner] + place
    return starts, ends, first, hashes, at, owner, words.windows(hashes, size)[at]


def _prefix(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    code = np.zeros(len(at), np.int64)
    for step, bits in enumerate(PREFIX_BITS):
        code = (code << bits) | (hashes[at + step] >> np.uint64(64 - bits)).astype(np.int64)
    return code


def _count_prefixes(size: int):
    def run(batches):
        total = np.zeros(1 << sum(PREFIX_BITS), np.int64)
        for _, data, limits in words.chunks(batches, "text"):
            _, _, _, hashes, at, _, _ = _suffixes(data, limits, size)
            total += np.bincount(_prefix(hashes, at), minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "count"])
    return run


def lay_out(counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """First group of every prefix, and in how many groups it is split."""
    first, splits = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group = filled = 0
    for code in np.flatnonzero(counts):
        count = int(counts[code])
        if filled and filled + count > room:
            group, filled = group + 1, 0
        first[code], splits[code] = group, -(-count // room)
        if count > room:
            group, filled = group + int(splits[code]), 0
        else:
            filled += count
    return first, splits


def _least_of_runs(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``keys``, and there the least rank among equal keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.minimum.reduceat(ranks[order], begin)
    return order, np.repeat(least, np.diff(np.append(begin, len(keys))))


_PACKED = ("docs", "keys", "counts", "hashes", "places")
_BY_CHUNK = "chunk long, " + ", ".join(f"{name} binary" for name in _PACKED)
_EMPTY = b""


def _send(size: int, first: np.ndarray, splits: np.ndarray):
    """Rows of packed suffixes per group, and one row of the windows lost already."""
    def run(batches):
        chunk = 0
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for batch, data, limits in words.chunks(batches, "text"):
            names = batch.schema.names
            ids = batch.column(names.index("rank")).to_numpy()
            keys = batch.column(names.index("text_key")).to_numpy()
            _, _, _, hashes, at, owner, window = _suffixes(data, limits, size)
            if not len(window):
                continue
            chunk += 1
            own = (task << 24) | chunk
            order, least = _least_of_runs(window, ids[owner])
            lost = np.zeros(len(window), bool)
            lost[order] = ids[owner][order] > least
            # of equal windows in one document only the first is sent
            again = np.zeros(len(window), bool)
            again[order[1:]] = ((window[order[1:]] == window[order[:-1]])
                                & (owner[order[1:]] == owner[order[:-1]]))
            code = _prefix(hashes, at)
            share = ((window >> np.uint64(32)) * splits[code].astype(np.uint64)) >> np.uint64(32)
            group = first[code] + share.astype(np.int64)
            sent = np.flatnonzero(~lost & ~again)
            sent = sent[np.argsort(group[sent], kind="stable")]
            rows = []
            if len(sent):
                cut = np.flatnonzero(np.diff(group[sent])) + 1
                for part in np.split(sent, cut):
                    docs, counts = np.unique(owner[part], return_counts=True)
                    rows.append((int(group[part[0]]), own, ids[docs].tobytes(), keys[docs].tobytes(),
                                 counts.astype(np.int64).tobytes(), window[part].tobytes(), _EMPTY))
            gone = np.flatnonzero(lost)
            if len(gone):
                docs, counts = np.unique(owner[gone], return_counts=True)
                rows.append((-1 - own, own, ids[docs].tobytes(), keys[docs].tobytes(),
                             counts.astype(np.int64).tobytes(), _EMPTY,
                             words.spread(np.bincount(owner))[gone].astype(np.int32).tobytes()))
            for low in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind.type) for column, kind in zip(zip(*rows[low:low + 64]), _SENT)],
                    schema=_SENT)
    return run


_SENT = pa.schema([("group", pa.int64()), ("chunk", pa.int64())] + [(n, pa.binary()) for n in _PACKED])
_LOST = pa.schema([("rank", pa.int64()), ("text_key", pa.int64()),
                   ("hashes", pa.binary()), ("places", pa.binary())])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(value.as_buffer(), kind) for value in column])


def _judge(part: pa.Table) -> pa.Table:
    """The windows of one group that some smaller document has too, packed per chunk."""
    if part["group"][0].as_py() < 0:
        return part.drop_columns("group")
    docs, keys = _joined(part["docs"], np.int64), _joined(part["keys"], np.int64)
    counts, window = _joined(part["counts"], np.int64), _joined(part["hashes"], np.uint64)
    owner = np.repeat(np.arange(len(docs)), counts)
    order, least = _least_of_runs(window, docs[owner])
    lost = np.sort(order[docs[owner][order] > least])
    losers, sizes = np.unique(owner[lost], return_counts=True)
    row = np.repeat(np.arange(len(part)), [len(value.as_buffer()) // 8 for value in part["docs"]])
    rows, first = np.unique(row[losers], return_index=True)
    limits = np.append(first, len(losers))
    return pa.Table.from_arrays(
        [part["chunk"].take(pa.array(rows)), words.blobs(docs[losers], limits),
         words.blobs(keys[losers], limits), words.blobs(sizes.astype(np.int64), limits),
         words.blobs(window[lost], np.concatenate([[0], np.cumsum(sizes)])[limits]),
         pa.array([_EMPTY] * len(rows), pa.binary())], ["chunk", *_PACKED])


def _per_document(part: pa.Table) -> pa.Table:
    """What all groups found in one chunk of text, a row per document."""
    pairs = np.stack([_joined(part["docs"], np.int64), _joined(part["keys"], np.int64)], axis=1)
    counts = _joined(part["counts"], np.int64)
    own, which = np.unique(pairs, axis=0, return_inverse=True)
    local = np.repeat([len(value.as_buffer()) > 0 for value in part["places"]],
                      [len(value.as_buffer()) // 8 for value in part["docs"]])

    def packed(values: np.ndarray, entries: np.ndarray) -> pa.Array:
        owner = np.repeat(which[entries], counts[entries])
        limits = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(own)))])
        return words.blobs(values[np.argsort(owner, kind="stable")], limits)

    return pa.Table.from_arrays(
        [pa.array(own[:, 0]), pa.array(own[:, 1]), packed(_joined(part["hashes"], np.uint64), ~local),
         packed(_joined(part["places"], np.int32), local)], schema=_LOST)


def _cut(size: int):
    def run(batches):
        for batch, data, limits in words.chunks(batches, "text"):
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            starts, ends, first, _, at, owner, window = _suffixes(data, limits, size)
            windows_of = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(limits) - 1))])
            hit = np.zeros(len(window), bool)
            for row, (hashes, places) in enumerate(zip(column["hashes"], column["places"])):
                low, high = windows_of[row], windows_of[row + 1]
                for value in places.values if places.is_valid else ():
                    hit[low + np.frombuffer(value.as_buffer(), np.int32)] = True
                lost = [np.frombuffer(v.as_buffer(), np.uint64)
                        for v in (hashes.values if hashes.is_valid else ())]
                if lost:
                    hit[low:high] |= np.isin(window[low:high], np.concatenate(lost))
            step = np.zeros(len(starts) + 1, np.int64)
            np.add.at(step, at[hit], 1)
            np.add.at(step, at[hit] + size, -1)
            keep = np.cumsum(step[:-1]) == 0
            kept_before = np.concatenate([[0], np.cumsum(keep)])
            n_words = np.diff(first)
            text, bounds = join_words(data, starts, ends, first, keep)
            yield pa.RecordBatch.from_arrays(
                [column["doc_id"], pa.array(n_words),
                 pa.array(n_words - np.diff(kept_before[first])),
                 pa.LargeStringArray.from_buffers(
                     len(limits) - 1, pa.py_buffer(bounds), pa.py_buffer(text)).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray,
               keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text's kept words with one space between them, and the texts' limits."""
    chosen = np.flatnonzero(keep)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[chosen]] += 1
    edge[ends[chosen]] -= 1
    taken = np.cumsum(edge, dtype=np.int8).view(bool)
    owner = np.searchsorted(first, chosen, "right")
    # a kept word that another of its text follows has a white byte after it
    gap = ends[chosen[:-1]][owner[1:] == owner[:-1]] if len(chosen) else chosen
    taken[gap] = True
    out = np.append(data, 0).astype(np.uint8)
    out[gap] = 0x20
    size = np.zeros(len(first), np.int64)
    np.add.at(size, owner, (ends - starts)[chosen])
    np.add.at(size, owner[:-1][owner[1:] == owner[:-1]] if len(chosen) else owner, 1)
    return out[taken], np.cumsum(size)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   min_words: int = 13, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text.

    A word goes when it lies in a window of ``min_words`` words that also starts in a document
    with a smaller doc_id; what is left is joined by single spaces. Windows are judged on the
    input. Repeats within one document stay. A NULL text has no words; a NULL doc_id counts as
    larger than all others, and rows that share a doc_id lose nothing to each other. Other
    columns are ignored. An empty table gives no rows.
    """
    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_LAST)).alias("rank"),
        F.xxhash64(F.col(text_column).cast("string")).alias("text_key"),
        F.col(text_column).cast("string").alias("text"))
    counts = np.zeros(1 << sum(PREFIX_BITS), np.int64)
    for code, count in (source.select("text").mapInArrow(_count_prefixes(min_words), "code long, count long")
                        .groupBy("code").agg(F.sum("count")).collect()):
        counts[code] = count
    first, splits = lay_out(counts, group_suffixes)
    # a task gets a few groups, however many there are
    groups = int((first + splits).max())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS_PER_TASK))
    with steps(docs.sparkSession) as keep:
        lost = settle(source.select("rank", "text_key", "text")
                      .mapInArrow(_send(min_words, first, splits), f"group long, {_BY_CHUNK}")
                      .repartition(tasks, "group").groupBy("group").applyInArrow(_judge, _BY_CHUNK)
                      .groupBy("chunk").applyInArrow(
                          _per_document, "rank long, text_key long, hashes binary, places binary"))
        per_document = keep(lost.groupBy("rank", "text_key").agg(
            F.collect_set(F.when(F.length("hashes") > 0, F.col("hashes"))).alias("hashes"),
            F.collect_set(F.when(F.length("places") > 0, F.col("places"))).alias("places")))
    return (source.join(per_document, ["rank", "text_key"], "left")
            .select("doc_id", "text", "hashes", "places")
            .mapInArrow(_cut(min_words),
                        "doc_id long, n_words long, n_removed long, kept_text string"))


def op6_substring_dedup(spark, folder: str) -> DataFrame:
    return (remove_repeats(table(spark, folder, "documents"))
            .withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text"))
