"""Packing documents into token sequences, in order, by dynamic programming.

Each input partition is one stream of tokens: documents in their order, each closed by an
end id. Cuts are allowed where a document or a sentence ends (and, inside a stretch that
has neither for a whole window, every window length). A plan of cuts costs its padding, a
penalty for each cut inside a document, and a little for each sequence; the cheapest plan
is found left to right. The best start of a window that is padded to full length is the
least of ``cost + position`` over the last window length, kept in a monotone queue; windows
whose length is a power of two need no padding and are looked up directly. Streams are
planned in blocks of about ``BLOCK_TOKENS``, so memory does not grow with a partition, and
nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import table

BLOCK_TOKENS = 1 << 20
SENTENCE_PENALTY, FORCED_PENALTY, SEQUENCE_COST = 8, 256, 8
#: Words whose ids a worker remembers; beyond that it starts anew.
CACHED_WORDS = 600_000


class _Words(dict):
    """Numbers words in the order they appear."""

    def __init__(self) -> None:
        super().__init__({None: 0, "": 1})
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class _PlainWords:
    """The same vocabulary for words of common Latin letters, digits and signs, in one call.

    Works for byte-level BPE whose words end in a suffix: the suffix becomes a zero byte that
    joins the last byte before any other merge. Words the class does not cover go through the
    tokenizer itself; tests hold both against each other.
    """

    _covered = re.compile(r"[ -~À-ÖØ-öø-įı-ɏ]*")
    _pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, model: dict) -> None:
        import tiktoken
        end = model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [byte for byte in range(256) if byte not in shown]
        byte_of = {chr(byte): byte for byte in shown} | {
            chr(256 + n): byte for n, byte in enumerate(hidden)}

        def raw(token: str) -> bytes:
            body = token.removesuffix(end)
            return bytes(byte_of[sign] for sign in body) + b"\0" * (body != token)

        singles = [bytes([byte]) for byte in range(256)]
        joined = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        order = singles + [single + b"\0" for single in singles[1:]] + [
            raw(left + right) for left, right in joined]
        ranks: dict[bytes, int] = {}
        for token in order:
            ranks.setdefault(token, len(ranks))
        self.id_of = np.zeros(len(ranks), np.uint32)
        for token, number in model["vocab"].items():
            if all(sign in byte_of for sign in token.removesuffix(end)) and raw(token) in ranks:
                self.id_of[ranks[raw(token)]] = number
        self.encoding = tiktoken.Encoding("plain words", pat_str=r"[^\x00\x01]+\x00|\x01",
                                          mergeable_ranks=ranks, special_tokens={})

    def covers(self, text: str) -> bool:
        return "<|" not in text and self._covered.fullmatch(text) is not None

    def ids_of(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        text = self._pieces.sub("\\g<0>\x00", " ".join(fresh).lower()).replace(" ", "\x01")
        ranks = np.array(self.encoding.encode_ordinary(text), np.int64)
        parted = ranks == 1
        ends = np.append(np.flatnonzero(parted), len(ranks))
        return self.id_of[ranks[~parted]], np.diff(ends, prepend=-1) - 1


class Encoder:
    """Ids of texts, each word encoded once; for tokenizers that drop white space.

    Texts are cut at spaces and line feeds only, which such a tokenizer never reads across.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        model = json.loads(self.tokenizer.to_str())["model"]
        self.plain = _PlainWords(model) if model.get("end_of_word_suffix") else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max([end_id, *vocabulary.values()]) + 1, bool)
        self.closes[[n for token, n in vocabulary.items() if re.fullmatch(r"[.!?]+(</w>)?", token)]] = True
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Words()
        self.ids = np.array([self.end_id], np.uint32)
        self.begin, self.length = np.array([0, 1], np.int64), np.array([1, 0], np.int64)

    def _learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        plain, odd = list(range(len(fresh))), []
        if self.plain is None:
            plain, odd = odd, plain
        elif not self.plain.covers(" ".join(fresh)):
            plain = [n for n, word in enumerate(fresh) if self.plain.covers(word)]
            odd = sorted(set(range(len(fresh))) - set(plain))
        length, parts = np.zeros(len(fresh), np.int64), [self.ids]
        if plain:
            ids, length[plain] = self.plain.ids_of([fresh[n] for n in plain])
            parts.append(ids)
        for n, found in zip(odd, self.tokenizer.encode_batch([fresh[n] for n in odd],
                                                             add_special_tokens=False)):
            length[n] = len(found.ids)
            parts.append(np.array(found.ids, np.uint32))
        order = np.array(plain + odd)
        begin = np.empty(len(fresh), np.int64)
        begin[order] = len(self.ids) + np.cumsum(length[order]) - length[order]
        self.begin, self.length = (np.concatenate(x) for x in (
            [self.begin, begin], [self.length, length]))
        self.ids = np.concatenate(parts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the limits of the texts; an end id closes each."""
        if len(self.numbers) > CACHED_WORDS:
            self._reset()
        number = self.numbers.__getitem__
        found, sizes = [], [0]
        for text in texts:
            parts = (text or "").replace("\n", " ").split(" ")
            parts.append(None)
            found.append(np.fromiter(map(number, parts), np.int64, len(parts)))
            sizes.append(len(parts))
        self._learn()
        used = np.concatenate(found) if found else np.empty(0, np.int64)
        length = self.length[used]
        where = np.repeat(self.begin[used], length) + words.spread(length)
        limits = np.concatenate([[0], np.cumsum(length)])[np.cumsum(sizes)]
        return self.ids[where], limits


def plan(size: int, inner: np.ndarray, sentences: np.ndarray, window: int) -> np.ndarray:
    """Ends of the cheapest windows over ``size`` tokens.

    ``inner`` are the ends of documents, ``sentences`` those of sentences inside them.
    """
    penalty = np.full(size + 1, -1, np.int64)
    penalty[sentences] = SENTENCE_PENALTY
    penalty[inner] = 0
    penalty[[0, size]] = 0
    free = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(free) > window)
    for low, high in zip(free[wide], free[wide + 1]):
        penalty[low + window:high:window] = FORCED_PENALTY
    spots = np.flatnonzero(penalty >= 0)
    index = np.full(size + 1, -1, np.int64)
    index[spots] = np.arange(len(spots))
    near: dict[int, list[int]] = {}
    for power in (1 << k for k in range(window.bit_length()) if 1 << k <= window):
        late = np.flatnonzero(spots >= power)
        early = index[spots[late] - power]
        for j, i in zip(late[early >= 0].tolist(), early[early >= 0].tolist()):
            near.setdefault(j, []).append(i)
    place, cost = spots.tolist(), [0] * len(spots)
    extra = (penalty[spots] + SEQUENCE_COST).tolist()
    back = [0] * len(spots)
    queue = deque([(0, 0, 0)])  # cost + place, place, number; the least first
    for j in range(1, len(place)):
        at = place[j]
        while queue[0][1] < at - window:
            queue.popleft()
        best, _, source = queue[0]
        best += window - at
        for i in near.get(j, ()):
            if cost[i] < best:
                best, source = cost[i], i
        cost[j] = best = best + extra[j]
        back[j] = source
        key = best + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, at, j))
    ends, j = [], len(place) - 1
    while j:
        ends.append(place[j])
        j = back[j]
    return np.array(ends[::-1], np.int64)


def pieces(limits: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Where documents (``limits``) and windows (``ends``) cut each other."""
    cuts = np.union1d(limits, ends)
    low, high = cuts[:-1], cuts[1:]
    owner = np.searchsorted(limits, low, "right") - 1
    window = np.searchsorted(ends, low, "right")
    begin = np.concatenate([[0], ends])
    return {"owner": owner, "low": low, "high": high, "start": low - limits[owner],
            "doc_tokens": (limits[1:] - limits[:-1])[owner], "sequence": window,
            "offset": low - begin[window], "sequence_tokens": (begin[1:] - begin[:-1])[window]}


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _pack(path: str, window: int, end_id: int):
    def run(batches):
        encoder = _ENCODERS.get((path, end_id)) or Encoder(path, end_id)
        _ENCODERS[path, end_id] = encoder
        task = TaskContext.get().partitionId()
        used, held, tokens = 0, [], 0

        def flush():
            nonlocal used, held, tokens
            ids = np.concatenate([part for _, part, _ in held])
            sizes = np.concatenate([np.diff(limits) for _, _, limits in held])
            limits = np.concatenate([[0], np.cumsum(sizes)])
            closing = np.flatnonzero(encoder.closes[ids]) + 1
            found = pieces(limits, plan(len(ids), limits, closing, window))
            names = pa.concat_arrays([doc_ids for doc_ids, _, _ in held])
            for low in range(0, len(found["low"]), 20_000):
                part = {name: values[low:low + 20_000] for name, values in found.items()}
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(part["owner"])), pa.array(part["start"]),
                     pa.array(part["high"] - part["low"]), pa.array(part["doc_tokens"]),
                     pa.array((task << 32) + used + part["sequence"]), pa.array(part["offset"]),
                     pa.array(part["sequence_tokens"]),
                     words.blobs(ids[part["low"][0]:part["high"][-1]],
                                 np.append(part["low"], part["high"][-1]) - part["low"][0])],
                    _COLUMNS)
            used += int(found["sequence"][-1]) + 1
            held, tokens = [], 0

        for batch, _, _ in words.chunks(batches, "text"):
            names = batch.schema.names
            ids, limits = encoder.encode(batch.column(names.index("text")).to_pylist())
            held.append((batch.column(names.index("doc_id")), ids, limits))
            tokens += len(ids)
            if tokens >= BLOCK_TOKENS:
                yield from flush()
        if held:
            yield from flush()
    return run


_COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset",
            "sequence_tokens", "ids"]


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
         window: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset,
    sequence_tokens (filled length of the sequence) and ids (little-endian 32-bit numbers).

    Every id of every document, its end id included, lies in exactly one piece; pieces of a
    sequence stand without gaps. The order of rows is the order of their partition. A NULL
    or empty text is its end id alone; doc_id is carried as it is, NULL, repeated or not.
    Other columns are ignored. An empty table gives no rows.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                         F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(
        _pack(tokenizer_path, window, end_id),
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
        "sequence_tokens long, ids binary")


def pack_with_digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers
        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(docs, tokenizer_path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "sequence_tokens")


def op9_packing(spark, folder: str) -> DataFrame:
    return pack_with_digests(table(spark, folder, "documents"))
