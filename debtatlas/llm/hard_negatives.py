"""Hard negatives by rotated one-bit codes.

Index: vectors are scaled to integers and turned by a fixed rotation (two rounds of signs and
a Hadamard transform). Of a turned vector x the code b keeps one sign per axis; beside it
stand its alignment, the inner product of x with the unit vector b / sqrt(d), and its norm.

Estimate: with q the turned anchor, t the inner product of q with that unit vector and a the
alignment, q.x = a t + the product of what q and x have across b. The first part is
estimated by popcounts of the code with the bit planes of a quantised q, whose error has a
known norm; the second is no larger than the product of two residual norms (Cauchy-Schwarz).
So every pair has an interval that holds its score for certain. Rows whose interval cannot
reach the answer are passed over; the others get their integer score. Nothing is lost.

Plan: rows are dealt into groups of some ``GROUP_ROWS`` by a serial number, so no label, id
or vector fills one. Each group meets all anchors in a stream: its rows first, which a task
holds, then the anchors batch by batch. One pass finds positives, a second negatives; both
keep the best few of a group and combine them per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import settle, table

POSITIVES, NEGATIVES, LEAST_PERCENT = 5, 5, 80
SCALE, RELABEL_EVERY, LABELS, ANCHOR_EVERY = 256, 7, 10, 100
GROUP_ROWS = 8_192
#: Bits of a quantised anchor.
PLANES = 6
_ANCHORS_AT_ONCE = 64
#: Larger integers could overflow a score; such vectors take no part.
_LARGEST = 1 << 26
_EXACT_DOUBLE = float(1 << 53)


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rows turned by one fixed rotation, padded to a power of two, 64 at least."""
    size = 64
    while size < vectors.shape[1]:
        size *= 2
    out = np.zeros((len(vectors), size))
    out[:, :vectors.shape[1]] = vectors
    for seed in (61, 62):
        out *= np.where(words.numbered(size, seed) & np.uint64(1), 1.0, -1.0)
        step = 1
        while step < size:
            pairs = out.reshape(len(out), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), size)
            step *= 2
        out /= np.sqrt(size)
    return out


def codes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs as words of 64 bits, and each row's alignment with its code vector."""
    signs = turned >= 0
    packed = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
    return packed, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


class Planes:
    """Anchors, turned and quantised to bit planes."""

    def __init__(self, vectors: np.ndarray) -> None:
        turned = rotated(vectors.astype(np.float64))
        self.size = turned.shape[1]
        self.low = turned.min(axis=1, keepdims=True)
        self.width = np.maximum(turned.max(axis=1, keepdims=True) - self.low, 1e-300) / ((1 << PLANES) - 1)
        levels = np.rint((turned - self.low) / self.width).astype(np.uint8)
        near = self.low + self.width * levels
        self.error = np.sqrt(((turned - near) ** 2).sum(axis=1, keepdims=True))
        self.total = near.sum(axis=1, keepdims=True)
        self.norm = np.sqrt((turned ** 2).sum(axis=1, keepdims=True))
        self.bits = [np.packbits((levels >> n) & 1, axis=1, bitorder="little").view(np.uint64) for n in range(PLANES)]

    def intervals(self, packed: np.ndarray, ones: np.ndarray, align: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score of every (anchor, row)."""
        counted = np.zeros((len(self.low), len(packed)), np.int32)
        for n, plane in enumerate(self.bits):
            for word in range(packed.shape[1]):
                counted += np.bitwise_count(plane[:, word, None] & packed[None, :, word]).astype(np.int32) << n
        root = np.sqrt(self.size)
        along = (2 * (self.low * ones + self.width * counted) - self.total) / root
        least = np.maximum(np.abs(along) - self.error, 0)
        across = np.sqrt(np.maximum(self.norm ** 2 - least ** 2, 0)) * np.sqrt(np.maximum(norm ** 2 - align ** 2, 0))
        half = align * self.error + across + 1e-9 * self.norm * norm + 1e-6
        middle = align * along
        return middle - half, middle + half


class Group:
    """Rows of one group, by id."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(parts)
        self.serials, self.ids, self.labels = (rows[c].to_numpy() for c in ("serial", "vec_id", "label"))
        order = np.lexsort((self.serials, self.ids))
        self.vectors = _matrix(rows["vector"], np.int32)[order]
        self.packed = _matrix(rows["code"], np.uint64)[order]
        self.align, self.norm = rows["align"].to_numpy()[order], rows["norm"].to_numpy()[order]
        self.serials, self.ids, self.labels = self.serials[order], self.ids[order], self.labels[order]
        self.ones = np.bitwise_count(self.packed).sum(axis=1, dtype=np.int32)
        self.by_label = {label: np.flatnonzero(self.labels == label) for label in np.unique(self.labels).tolist()}

    def intervals(self, planes: Planes, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return planes.intervals(self.packed[some], self.ones[some], self.align[some], self.norm[some])

    def scores(self, anchor: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Integer inner products. Doubles hold them exactly where norms say so."""
        rows = self.vectors[some]
        if len(rows) and np.linalg.norm(anchor.astype(np.float64)) * self.norm[some].max() < _EXACT_DOUBLE / 4:
            return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
        return (rows.astype(np.int64) * anchor.astype(np.int64)).sum(axis=1)


def _matrix(column, kind) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _batch(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()) for values in zip(*found)], names)


def best_positives(group: Group, anchors: pa.RecordBatch) -> list[tuple]:
    """(anchor serial, id, serial, score) of the best other rows with an anchor's label."""
    column = {name: anchors.column(i) for i, name in enumerate(anchors.schema.names)}
    labels, serials = column["label"].to_numpy(), column["serial"].to_numpy()
    vectors = _matrix(column["vector"], np.int32)
    found = []
    for label in np.unique(labels).tolist():
        some = group.by_label.get(label)
        if some is None:
            continue
        own = np.flatnonzero(labels == label)
        low, high = group.intervals(Planes(vectors[own]), some)
        self_row = group.serials[some][None, :] == serials[own][:, None]
        low[self_row] = high[self_row] = -np.inf
        if len(some) > POSITIVES:
            floor = np.partition(low, len(some) - POSITIVES, axis=1)[:, len(some) - POSITIVES]
        else:
            floor = np.full(len(own), -np.inf)
        keep = (high >= floor[:, None]) & ~self_row
        for n, anchor in enumerate(own):
            rows = some[keep[n]]
            scores = group.scores(vectors[anchor], rows)
            for at in np.lexsort((group.ids[rows], -scores))[:POSITIVES]:
                found.append((serials[anchor], group.ids[rows[at]], group.serials[rows[at]], scores[at]))
    return found


def best_negatives(group: Group, anchors: pa.RecordBatch) -> list[tuple]:
    """(anchor serial, positive's place, id, score) of the best rows of other labels whose score
    lies between ``LEAST_PERCENT`` of a positive's and the positive's own."""
    column = {name: anchors.column(i) for i, name in enumerate(anchors.schema.names)}
    labels, serials = column["label"].to_numpy(), column["serial"].to_numpy()
    vectors = _matrix(column["vector"], np.int32)
    limits = [np.array(positives, np.int64) for positives in column["positives"].to_pylist()]
    everyone = np.arange(len(group.ids))
    low, high = group.intervals(Planes(vectors), everyone)
    found = []
    for n, wanted in enumerate(limits):
        wanted_low = LEAST_PERCENT * int(wanted.min()) / 100
        keep = (high[n] >= wanted_low) & (low[n] <= int(wanted.max())) & (group.labels != labels[n])
        rows = np.flatnonzero(keep)
        scores = group.scores(vectors[n], rows)
        fits = (100 * scores >= LEAST_PERCENT * int(wanted.min())) & (scores <= wanted.max())
        rows, scores = rows[fits], scores[fits]
        order = np.lexsort((group.ids[rows], -scores))
        rows, scores = rows[order], scores[order]
        for place, positive in enumerate(wanted.tolist()):
            first = int(np.searchsorted(-scores, -positive, "left"))
            for at in range(first, min(first + NEGATIVES, len(rows))):
                if 100 * int(scores[at]) < LEAST_PERCENT * positive:
                    break
                found.append((serials[n], place, group.ids[rows[at]], scores[at]))
    return found


def _search(answer, names: list[str]):
    """Stream of (group, kind): the rows of a group, then the anchors that it meets."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        now, parts, group = None, [], None
        for batch in batches:
            kinds = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("group", "kind")])
            cuts = np.flatnonzero((kinds[:, 1:] != kinds[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                here, kind = (int(x) for x in kinds[:, low])
                if here != now:
                    now, parts, group = here, [], None
                if kind == 0:
                    parts.append(batch.slice(low, high - low))
                    continue
                if not parts:
                    continue
                group = group or Group(parts)
                for at in range(low, high, _ANCHORS_AT_ONCE):
                    found = answer(group, batch.slice(at, min(_ANCHORS_AT_ONCE, high - at)))
                    if found:
                        yield _batch(found, names)
    return run


_ROW = "vec_id long, label long, serial long, vector binary, code binary, align double, norm double"


def _encode(size: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            lists = column["embedding"]
            values = lists.flatten()
            numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
            good = values.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(numbers)
            with np.errstate(invalid="ignore"):
                whole = np.floor(SCALE * numbers)
            good &= np.abs(np.where(good, whole, 0)) < _LARGEST
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~good)])
            fit = np.flatnonzero(bad[ends] == bad[ends - lengths])
            ints = np.zeros((len(fit), size), np.int32)
            where = np.repeat(ends[fit] - lengths[fit], lengths[fit]) + words.spread(lengths[fit])
            ints[np.repeat(np.arange(len(fit)), lengths[fit]), words.spread(lengths[fit])] = whole[where].astype(np.int32)
            turned = rotated(ints.astype(np.float64))
            packed, align = codes(turned)
            take = pa.array(fit)
            yield pa.RecordBatch.from_arrays(
                [column[c].take(take) for c in ("vec_id", "label", "serial")]
                + [words.blobs(ints.ravel(), np.arange(len(fit) + 1) * ints.shape[1]),
                   words.blobs(packed.ravel(), np.arange(len(fit) + 1) * packed.shape[1]),
                   pa.array(align), pa.array(np.sqrt((ints.astype(np.float64) ** 2).sum(axis=1)))],
                ["vec_id", "label", "serial", "vector", "code", "align", "norm"])
    return run


def _meet(index: DataFrame, anchors: DataFrame, groups: int, answer, names: list[str]) -> DataFrame:
    """What every group of rows answers every anchor."""
    def dealt(rows: DataFrame, group: Column, kind: int) -> DataFrame:
        return rows.withColumn("group", group).withColumn("kind", F.lit(kind))

    rows = dealt(index.withColumn("positives", F.lit(None).cast("array<long>")),
                 F.pmod(F.xxhash64("serial"), F.lit(groups)).cast("int"), 0)
    asked = dealt(anchors, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), 1)
    return (rows.unionByName(asked).repartition("group").sortWithinPartitions("group", "kind")
            .mapInArrow(_search(answer, names), ", ".join(f"{name} long" for name in names)))


def mine(vectors: DataFrame, id_column: str = "vec_id", label_column: str = "label",
         vector_column: str = "embedding", group_rows: int = GROUP_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``ANCHOR_EVERY``. Positives and negatives go by
    score, higher first, then by smaller id. Rows with a NULL id, label or vector, a NULL or
    non-finite component, or one beyond 2^18 (whose scores a long may not hold) take no part.
    A shorter vector counts as padded with zeros. Rows that share an id are rows of their own,
    each the others' neighbour. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and label is not null and embedding is not null")
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    size = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    index = settle(rows.select("vec_id", moved.alias("label"), F.monotonically_increasing_id().alias("serial"), "embedding")
                   .mapInArrow(_encode(size), _ROW))
    groups = max(1, -(-index.count() // group_rows))
    anchors = index.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    near = _meet(index, anchors.withColumn("positives", F.lit(None).cast("array<long>")), groups, best_positives,
                 ["anchor", "positive_id", "positive", "positive_score"])
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    positives = settle(near.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < POSITIVES)
                       .select("anchor", "place", "positive_id", "positive_score"))
    limits = positives.groupBy("anchor").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    asked = anchors.join(limits.withColumnRenamed("anchor", "serial"), "serial")
    hard = _meet(index, asked, groups, best_negatives, ["anchor", "place", "negative_id", "negative_score"])
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    kept = hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= NEGATIVES)
    return (kept.join(positives, ["anchor", "place"])
            .join(anchors.select(F.col("serial").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op11_hard_negatives(spark, folder: str) -> DataFrame:
    return mine(table(spark, folder, "embeddings"))


OP11_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER hardest)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW hardest AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER hardest <= 5
"""
