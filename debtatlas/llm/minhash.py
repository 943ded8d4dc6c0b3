"""Near-duplicate documents by one-permutation MinHash.

Signature: one hash throws a document's shingles into bins, each bin
keeps its least value, and empty bins copy a filled one picked by their own probe
sequence (optimal densification). Buckets: some bins make a band, equal bands meet.
Edges: the member of a bucket that meets most others is its centre, and only (centre, member)
pairs are compared, on full shingle sets. Where a bucket's members are not one component after
that, one member of each component is compared with one of the largest, in turns as long as
that joins components. What is then left apart is searched for further links by an exact prefix
join on rare shingles, so links aside of a centre are found, and neither pairs inside a bucket
nor all links of a group are ever listed. Documents
with equal sets are one class before all this. Bands have as many bins as a chance of
``MISS`` to overlook a pair right at the threshold allows: 5 at a similarity of 0.85, 4 at 0.8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import settle, steps, table
from .components import components

BANDS = 24
#: Chance that a pair right at the threshold shares no bucket.
MISS = 1e-5
#: How often components of a bucket are compared by one member each before the exact join.
TURNS = 8
#: Counters for how common shingles are; what is common only decides an order.
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
_VALUE_BITS = 40
_SEED, _PROBES, _BAND = words.numbered(3, 41)


def rows_per_band(bands: int, percent: int) -> int:
    """The most rows with which a pair at the threshold is missed with a chance up to ``MISS``."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** bands <= MISS and rows < 64:
        rows += 1
    return rows


def shingle_sets(data: np.ndarray, limits: np.ndarray, size: int,
                 codes: np.ndarray = words.BYTES_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their limits.

    A text with fewer than ``size`` words has its whole sequence as its one shingle.
    """
    starts, ends, first = words.split(data, limits)
    hashes = words.hash_words(data, starts, ends, codes)
    n_words = np.diff(first)
    counts = np.where(n_words >= size, n_words - size + 1, n_words > 0)
    out = np.empty(int(counts.sum()), np.uint64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    full = words.windows(hashes, size)
    for i in range(len(n_words)):
        low, high = first[i], bounds[i]
        if n_words[i] >= size:
            part = out[high:bounds[i + 1]]
            part[:] = full[low:low + counts[i]]
            part.sort()
        elif n_words[i]:
            out[high] = words.windows(hashes[low:first[i + 1]], n_words[i])[0] ^ _SEED
    if not len(out):
        return out, bounds
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(out)]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def signatures(sets: np.ndarray, limits: np.ndarray, size: int) -> np.ndarray:
    """Densified one-permutation signatures, a row per set; rows of empty sets mean nothing."""
    n = len(limits) - 1
    out = np.zeros((n, size), np.uint64)
    step = max(1, (1 << (64 - _VALUE_BITS)) // size)
    for low in range(0, n, step):
        high = min(n, low + step)
        values = words.mix(sets[limits[low]:limits[high]] ^ _SEED)
        bins = ((values >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        owner = np.repeat(np.arange(high - low, dtype=np.uint64), np.diff(limits[low:high + 1]))
        # the bin decides the high bits of a value, so the low ones are what is compared
        keyed = ((owner * np.uint64(size) + bins) << np.uint64(_VALUE_BITS)) | (
            words.mix(values) >> np.uint64(64 - _VALUE_BITS))
        keyed.sort()
        cell = (keyed >> np.uint64(_VALUE_BITS)).astype(np.int64)
        least = np.ones(len(cell), bool)
        least[1:] = cell[1:] != cell[:-1]
        table = np.zeros((high - low) * size, np.uint64)
        filled = np.zeros(len(table), bool)
        table[cell[least]] = keyed[least] & np.uint64((1 << _VALUE_BITS) - 1)
        filled[cell[least]] = True
        some = np.repeat(filled.reshape(-1, size).any(axis=1), size)
        empty = np.flatnonzero(~filled & some)
        attempt = 0
        while len(empty):
            attempt += 1
            probe = words.mix((empty % size + attempt * size).astype(np.uint64) ^ _PROBES)
            source = empty - empty % size + (probe % np.uint64(size)).astype(np.int64)
            hit = filled[source]
            table[empty[hit]] = table[source[hit]]
            empty = empty[~hit]
        out[low:high] = table.reshape(-1, size)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = signature.reshape(len(signature), -1, rows)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64) ^ _BAND, bands.shape[:2])
    for row in range(rows):
        keys = words.mix(keys ^ bands[:, :, row]) + np.uint64(row)
    return keys


def _lists(table: np.ndarray) -> pa.Array:
    offsets = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(table).ravel()))


def _sign(shingle: int, rows: int, id_column: str, text_column: str):
    def run(batches):
        for batch, data, limits in words.chunks(batches, text_column):
            sets, at = shingle_sets(data, limits, shingle)
            keys = band_keys(signatures(sets, at, BANDS * rows), rows).view(np.int64)
            digests = [_key(sets[at[i]:at[i + 1]]) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(id_column)).cast(pa.int64()),
                 pa.array(np.diff(at)), pa.array(digests, pa.binary()),
                 _lists(keys)],
                ["id", "n", "set_key", "bands"])
    return run


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(shingle: int):
    """The sets of the texts that have the key their class has."""
    def run(batches):
        for batch, data, limits in words.chunks(batches, "text"):
            sets, at = shingle_sets(data, limits, shingle)
            wanted = batch.column(batch.schema.get_field_index("set_key")).to_pylist()
            own = [_key(sets[at[i]:at[i + 1]]) == wanted[i] for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("member")), words.blobs(sets, at)],
                ["member", "sets"]).filter(pa.array(own))
    return run


def _alike(percent: int):
    """Keep (centre, member, linked); both sets are sorted and distinct."""
    def run(batches):
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            linked = []
            for left, right in zip(column["centre_sets"], column["sets"]):
                a = np.frombuffer(left.as_buffer(), np.uint64)
                b = np.frombuffer(right.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays(
                [column["centre"], column["member"], pa.array(linked, pa.bool_())],
                ["centre", "member", "linked"])
    return run


def _around(rows: DataFrame) -> DataFrame:
    """(bucket, centre, member): the centre of each bucket with every other member.

    The centre is the member that meets most others over all its buckets: what is like any
    member of a group of copies is mostly like the one with the fewest edits.
    """
    sizes = settle(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = settle(rows.join(sizes, "bucket").groupBy("member")
                    .agg(F.sum("n").alias("met"), F.collect_list("bucket").alias("buckets"))
                    .select("member", "met", F.explode("buckets").alias("bucket")))
    centres = settle(shared.groupBy("bucket").agg(
        F.max_by("member", F.struct("met", -F.col("member"))).alias("centre")))
    return settle(shared.join(centres, "bucket").where("member != centre").select("bucket", "centre", "member"))


def _across(rows: DataFrame, turn: int) -> DataFrame:
    """(centre, member): in each bucket, a member of its largest component with one of each
    other; which ones changes with ``turn``."""
    chosen = settle(rows.groupBy("bucket", "component").agg(
        F.max_by("member", F.xxhash64("member", F.lit(turn))).alias("member"), F.count("*").alias("n")))
    centres = settle(chosen.groupBy("bucket").agg(F.max_by("member", F.struct("n", "member")).alias("centre")))
    return settle(chosen.join(centres, "bucket").where("member != centre").select("centre", "member").distinct())


def _still_open(rows: DataFrame) -> DataFrame:
    """Rows of the buckets whose members are in several components."""
    open_buckets = settle(rows.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("open"))
                          .where("open").select("bucket"))
    return settle(rows.join(open_buckets, "bucket", "left_semi"))


def _common_shingles(members: DataFrame) -> np.ndarray:
    """How often shingles occur, added up in ``SLOTS`` slots whatever the number of members."""
    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts += np.bincount(_slot(np.frombuffer(value.as_buffer(), np.uint64)), minlength=SLOTS)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(counts[filled])], ["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    for row in (members.select("sets").mapInArrow(run, "slot long, n long")
                .groupBy("slot").agg(F.sum("n").alias("n")).collect()):
        counts[row.slot] = row.n
    return counts


def _slices(batch: pa.RecordBatch, rows: int = 512) -> list[pa.RecordBatch]:
    return [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)]


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _prefixes(counts: np.ndarray, percent: int):
    """The shingles by which a set can first meet a set it is linked with, rarest first.

    ``most`` is the largest set such a meeting still allows: all shingles before it are not
    shared. ``a`` to ``d`` hold, for 256 classes of shingles, whether their number is odd.
    """
    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole)):
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ends, shingles, most, parity = [0], [], [], []
            for value in column["sets"]:
                own = np.frombuffer(value.as_buffer(), np.uint64)
                n = len(own)
                order = np.lexsort((own, counts[_slot(own)]))[:n - -(-percent * n // 100) + 1]
                shingles.append(own[order])
                left = n - np.arange(len(order))
                most.append((left * (100 + percent) - percent * n) // percent)
                odd = np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256) & 1
                parity.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
                ends.append(ends[-1] + len(order))
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
            bits = np.stack(parity)[owner.to_numpy()]
            size = pa.array(np.array([len(value.as_buffer()) // 8 for value in column["sets"]]))
            yield pa.RecordBatch.from_arrays(
                [column["member"].take(owner), column["component"].take(owner), size.take(owner),
                 pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(most)),
                 *[pa.array(np.ascontiguousarray(bits[:, n])) for n in range(4)]],
                ["member", "component", "n", "shingle", "most", *"abcd"])
    return run


def _apart(members: DataFrame, percent: int) -> DataFrame:
    """(centre, member): every linked pair of members in two components, and few others.

    An exact prefix join: shingles are put in one order, rare ones first, and two linked sets
    share one of the first shingles of each. What their places and sizes, and the parities
    of their shingle classes, rule out is dropped inside the join, so the rows that come out
    follow the links between components, not the sizes of buckets.
    """
    rows = settle(members.mapInArrow(
        _prefixes(_common_shingles(members), percent),
        "member long, component long, n long, shingle long, most long, a long, b long, c long, d long"))
    left, right = rows.alias("l"), rows.hint("merge").alias("r")
    unlike = " + ".join(f"bit_count(l.{part} ^ r.{part})" for part in "abcd")
    return settle(left.join(right, F.expr(
        "l.shingle = r.shingle and l.member < r.member and l.component != r.component"
        " and l.n <= r.most and r.n <= l.most"
        f" and ({unlike}) * {100 + percent} <= {100 - percent} * (l.n + r.n)"))
        .select(F.col("l.member").alias("centre"), F.col("r.member").alias("member")).distinct())


def _components(docs: DataFrame, classes: DataFrame, ties: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the classes that have a verified link or one of ``ties``."""
    sizes = classes.select("member", "n")

    def judge(meeting: DataFrame) -> DataFrame:
        pairs = (meeting.select("centre", "member").distinct()
                 .join(sizes, "member")
                 .join(sizes.toDF("centre", "m"), "centre")
                 .where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
                 .select("centre", "member"))
        return settle(
            pairs.join(sets.toDF("member", "sets"), "member")
            .join(sets.toDF("centre", "centre_sets"), "centre")
            .mapInArrow(_alike(percent), "centre long, member long, linked boolean")
            .where("linked").select("centre", "member"))

    # smaller sets are linked with equal ones only: one more shingle already is too many
    rows = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select(
        "member", F.explode("bands").alias("bucket"))
    meeting = _around(rows)
    wanted = settle(meeting.select("member").union(meeting.select("centre")).distinct())
    sets = settle(docs.join(classes.join(wanted, "member", "left_semi").select("member", "id", "set_key"), "id")
                  .mapInArrow(_sets(shingle), "member long, sets binary").dropDuplicates(["member"]))
    found = judge(meeting).union(ties)
    # who is linked to a centre may still be the only link of another member, so all stay
    together = settle(meeting.select("bucket", "member").union(
        meeting.select("bucket", F.col("centre").alias("member")).distinct()))

    def still_open() -> DataFrame:
        return _still_open(settle(together.join(components(found).withColumnRenamed("node", "member"), "member", "left")
                                  .withColumn("component", F.coalesce("component", "member"))))

    rest = still_open()
    for turn in range(TURNS):
        others = _across(rest, turn)
        more = judge(others)
        if more.isEmpty():
            break
        found = settle(found.union(more))
        rest = still_open()
        if 100 * more.count() < others.count():
            break
    members = settle(rest.select("member", "component").distinct())
    apart = _apart(settle(members.join(sets, "member")), percent)
    return components(found.union(judge(apart)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when ``percent`` of the union of their shingle sets is common;
    words are taken after lower-casing A-Z. ``component_id`` is the least doc_id that links
    lead to, and ``kept`` marks the document that has it. Empty, blank and NULL texts have
    no shingles and stand alone. Rows without a doc_id cannot be named: they are linked with
    nothing, have a NULL component and are kept. Rows that share a doc_id are one document,
    which is linked with what any of their texts is; each has the size of its own set. Other columns are ignored. An empty table gives no rows.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"),
                         F.col(text_column).cast("string").alias("text"))
    signed = settle(source.mapInArrow(
        _sign(shingle, rows_per_band(BANDS, percent), "id", "text"), "id long, n long, set_key binary, bands array<long>"))
    whole = signed.where("n > 0 and id is not null")
    with steps(docs.sparkSession) as keep:
        # a class of equal sets has a number of its own: an id may stand for several texts
        classes = settle(whole.groupBy("set_key").agg(
            F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
            .withColumn("member", F.monotonically_increasing_id()))
        shared = settle(whole.groupBy("id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("other"))
                        .where("one != other").select("id"))
        ties = settle(whole.join(shared, "id").select("id", "set_key").distinct()
                      .join(classes.select("set_key", "member"), "set_key"))
        ties = settle(ties.join(ties.groupBy("id").agg(F.min("member").alias("centre")), "id")
                      .where("member != centre").select("centre", "member"))
        named = settle(classes.select("set_key", "member", "id").join(
            _components(source, classes, ties, shingle, percent).withColumnRenamed("node", "member"), "member", "left")
            .withColumn("component", F.coalesce("component", "member")))
        least = settle(named.groupBy("component").agg(F.min("id").alias("component_id")))
        named = keep(named.join(least, "component").select("set_key", "component_id"))
    alone = signed.where("not (n > 0 and id is not null)").select(
        "id", "n", F.col("id").alias("component_id"))
    return (whole.join(named, "set_key").select("id", "n", "component_id").unionByName(alone)
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))


def op4_minhash_near_dedup(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85)
