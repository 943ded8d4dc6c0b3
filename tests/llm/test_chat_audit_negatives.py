"""Chat formatting, the filter audit and hard negatives against plain forms."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from compare import difference
from corpora import corpus, prose
from debtatlas.llm import chat_format, filter_audit, hard_negatives, registry
from debtatlas.llm.common import reach_workers

SIGNS = ["<", "|", "turn|>", "[", "INST]", "/INST]", "\\", "s>", "/s>", "é", "\n", "x", "<|end|>", "<s>"]


def noise(draw, most=12):
    return "".join(draw.choice(SIGNS) for _ in range(draw.randrange(most)))


# --- chat ------------------------------------------------------------------------------------

def turns_of(rows):
    """The turns of each conversation in order; equal numbers by role, as no texts tie in the tests."""
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def chat_answer(rows):
    out = {}
    for conv, turns in turns_of(rows).items():
        learned = "".join(text for role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned),
                     hashlib.sha256(learned.encode()).hexdigest())
    return out


def digests(frame):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
            for r in chat_format.read_back(chat_format.format_conversations(frame)).collect()}


CHAT = "conv_id long, turn long, role string, text string"


def chats():
    draw = random.Random(4)
    rows = [(c, t, draw.choice(["user", "assistant", "system"]), noise(draw)) for c in range(40) for t in range(draw.randrange(1, 6))]
    return rows + [(None, 1, "user", "no id"), (None, 0, "assistant", "first"), (50, 0, None, "no role"), (51, 0, "assistant", None),
                   (52, None, "user", "before"), (52, 0, "assistant", "after"), (53, 7, "a\n\\n<s>", "odd role"),
                   (54, 3, "user", "twice"), (54, 3, "user", "twice"), (55, 0, "assistant", prose(1, 30_000)), (-9, 0, "assistant", "")]


def test_conversations_come_back(frame):
    rows = chats()
    assert digests(frame(rows, CHAT)) == chat_answer(rows)
    assert digests(frame([], CHAT)) == {}


def test_a_conversation_over_many_slices(spark, frame):
    """One conversation holds most rows: several tasks format it, and its digest is still whole."""
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <s>") for t in range(3000)] + [(c, 0, "assistant", "x") for c in range(2, 40)]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = chat_format.format_conversations(frame(rows, CHAT))
        assert len({r.slice for r in pieces.where("conv_id = 1").select("slice").collect()}) > 1
        assert digests(frame(rows, CHAT)) == chat_answer(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_columns_are_assembled_like_single_texts(monkeypatch):
    draw = random.Random(1)
    for run_bytes in (1 << 20, 1, 9):
        monkeypatch.setattr(chat_format, "_RUN_BYTES", run_bytes)
        for _ in range(150):
            texts = [noise(draw).encode() for _ in range(draw.randrange(1, 9))]
            roles = [draw.choice(["user", "assistant", None, "a\nb", "<s>\\n"]) for _ in texts]
            limits = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            out, turns, starts, ends = chat_format.assemble(
                np.frombuffer(b"".join(texts), np.uint8), limits, pa.array(roles, pa.string()))
            want = [chat_format._header(r) + chat_format.escape(t) + chat_format.END for r, t in zip(roles, texts)]
            assert out.tobytes() == b"".join(want) and turns.tolist() == [0, *np.cumsum([len(w) for w in want]).tolist()]
            assert [chat_format.unescape(out[a:b].tobytes()) for a, b in zip(starts, ends)] == texts
            for role, text in zip(roles, texts):
                escaped = chat_format.escape(text)
                assert not any(control in escaped for control in chat_format.CONTROL)
                assert chat_format._role(chat_format._header(role)[len(chat_format.TURN):-1]) == (role or "").encode()


def test_long_conversations_are_handed_on_not_held(monkeypatch):
    """Above the bound pieces go out unfinished, in order, and nothing is lost."""
    monkeypatch.setattr(chat_format, "HELD_BYTES", 40)
    names = ["conv_id", "slice", "part", "n_turns", "text", "loss_starts", "loss_ends"]
    text = "<|turn|>user\nabc<|end|>\n"
    rows = [(c, 0, n, 1, text, [], []) for n, c in enumerate([1, 2, 2, 2, 2, 3, 4])]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    out = [r for b in chat_format._read_slices([batch]) for r in b.to_pylist()]
    assert [(r["conv_id"], r["text"] is None) for r in out] == [
        (1, False), (2, False), (2, False), (2, False), (2, False), (3, True), (4, False)]
    again = [r for b in chat_format._read_whole([pa.RecordBatch.from_pylist(
        [{k: r[k] for k in names} for r in out if r["text"] is not None])]) for r in b.to_pylist()]
    assert [(r["conv_id"], r["n_turns"]) for r in again] == [(1, 1), (2, 4), (4, 1)]


# --- filter audit ------------------------------------------------------------------------------

def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def audit_answer(docs, labels):
    texts = {}
    for doc, text, _ in docs:
        if doc is not None:
            texts[text or ""] = min(doc, texts.get(text or "", doc))
    rows, parts = [], set()
    for doc, text, lang in docs:
        text, ws, part = text or "", words_of(text or ""), lang or ""
        fails = "".join(name for name, failing in zip("ABCDE", (
            len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws),
            100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text),
            doc is not None and texts.get(text, doc) < doc)) if failing)
        own = [(q, t) for d, q, t in labels if d is not None and d == doc]
        rows.append((part, fails, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
        parts.add(part)
    out = {}
    for part in parts:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                before = set(order[:step])
                gone = [r for r in rows if r[0] == part and before & set(r[1])]
                left = [r for r in rows if r[0] == part and not before & set(r[1])]
                lost = [r for r in left if name in r[1]]
                shapley[name] += len(lost)
                out[part, "".join(order), step + 1] = [
                    len(left) - len(lost), len(lost), sum(name in r[1] for r in gone),
                    sum(r[0] == part and r[1] == name for r in rows), sum(r[2] for r in lost), sum(r[3] for r in lost), name]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(frame):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in frame.collect()}


DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def test_audit_is_what_applying_the_filters_gives(frame):
    draw = random.Random(2)
    docs = [(doc, text, draw.choice(["en", "de", None, ""])) for doc, text in corpus()]
    docs += [(100 + n, prose(n, 250) + draw.choice(["", " #", " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"]), "en") for n in range(8)]
    docs += [(200, prose(0, 250), "de"), (201, "same " * 300, "xx"), (202, "A B # " * 300, "xx")]
    labels = [(doc, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for doc, _, _ in docs if draw.random() < 0.7]
    labels += [(10, 1, 0), (10, 0, 1), (None, 1, 1)]
    got = audited(filter_audit.audit(frame(docs, DOCS), frame(labels, LABELS)))
    assert got == audit_answer(docs, labels)
    assert audited(filter_audit.audit(frame([], DOCS), frame(labels, LABELS))) == {}


@pytest.mark.parametrize("slice_bytes", [1 << 20, 64, 7, 1])
def test_transducer_counts_like_a_plain_reader(monkeypatch, slice_bytes):
    monkeypatch.setattr(filter_audit, "_SLICE", slice_bytes)
    draw = random.Random(3)
    signs = ["a", "B", "é", "日", " ", "\n", "\t", "#", "&", "word", "Word", "\x1c", " ", "|", "x"]
    for _ in range(60):
        texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(30))) for _ in range(draw.randrange(1, 7))]
        raw = [t.encode() for t in texts]
        limits = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        read = filter_audit.transduce(data, limits)
        distinct = filter_audit.distinct_words(data, read["starts"], read["ends"], read["owner"], len(texts))
        got = list(zip(np.bincount(read["owner"], minlength=len(texts)), distinct, read["points"], read["capitals"], read["symbols"]))
        assert got == [(len(words_of(t)), len(set(words_of(t))), len(t), sum("A" <= c <= "Z" for c in t),
                        sum(c in "#$%&*|" for c in t)) for t in texts]


def test_words_are_compared_where_hashes_agree(monkeypatch):
    monkeypatch.setattr(filter_audit.words, "hash_words", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    text = " ".join(random.Random(5).choice("abcdefgh") * 3 for _ in range(90)).encode()
    data, limits = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    read = filter_audit.transduce(data, limits)
    assert filter_audit.distinct_words(data, read["starts"], read["ends"], read["owner"], 1).tolist() == [len(set(text.split()))]


# --- hard negatives ------------------------------------------------------------------------------

def negatives_answer(rows):
    kept = []
    for serial, (vec, label, values) in enumerate(rows):
        if None in (vec, label) or values is None or any(v is None or not math.isfinite(v) or abs(v) >= 2 ** 18 for v in values):
            continue
        label = int(math.fmod(label + 1, 10)) if vec % 7 == 0 else label
        kept.append((vec, label, [math.floor(256 * v) for v in values], serial))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for vec, label, values, serial in kept:
        if vec % 100:
            continue
        others = sorted(((-score(values, r[2]), r[0], r[1]) for r in kept if r[3] != serial))
        for neg, positive, _ in [o for o in others if o[2] == label][:5]:
            fits = [o for o in others if o[2] != label and 80 * -neg <= 100 * -o[0] <= 100 * -neg]
            out += [(vec, positive, rank + 1, o[1], -neg, -o[0]) for rank, o in enumerate(fits[:5])]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>"


def mined(frame, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(frame, **options).collect())


def vectors(count, size, labels=3, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, size))
    rows = []
    for n in range(count):
        label = int(draw.integers(labels))
        rows.append((n, label, (centres[int(draw.integers(labels))] * 0.5 + draw.normal(size=size)).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("size, group_rows", [(64, 8192), (5, 37), (70, 50), (1, 40)])
def test_no_negative_is_missed(frame, size, group_rows):
    rows = vectors(420, size)
    assert mined(frame(rows, VECTORS), group_rows=group_rows) == negatives_answer(rows)


def test_awkward_vectors(frame):
    rows = vectors(150, 6)
    one = rows[3][2]
    rows += [(None, 1, one), (500, None, one), (501, 1, None), (502, 1, [None, *one[1:]]), (503, 1, [math.nan, *one[1:]]),
             (504, 1, [math.inf, *one[1:]]), (505, 1, [1e30, *one[1:]]), (506, 1, []), (600, 2, [0.0] * 6), (700, 2, one[:3])]
    rows += [(800 + n, n % 2, one) for n in range(60)] + [(900, 0, one), (900, 0, one), (-100, 1, one), (-7, -3, one)]
    assert mined(frame(rows, VECTORS), group_rows=30) == negatives_answer(rows)
    assert mined(frame([], VECTORS)) == []
    assert mined(frame([(0, 1, one)], VECTORS)) == []


def test_intervals_hold_every_score():
    draw = np.random.default_rng(7)
    for size in (3, 64, 100):
        rows, anchors = (draw.integers(-90, 90, (40, size)) for _ in range(2))
        rows[:3] = [np.zeros(size), anchors[0], -anchors[1]]
        turned = hard_negatives.rotated(rows.astype(float))
        assert np.allclose(turned @ hard_negatives.rotated(anchors.astype(float)).T, rows @ anchors.T)
        packed, align = hard_negatives.codes(turned)
        low, high = hard_negatives.Planes(anchors).intervals(
            packed, np.bitwise_count(packed).sum(axis=1, dtype=np.int32), align, np.sqrt((rows ** 2).sum(axis=1)))
        scores = anchors @ rows.T
        assert (low <= scores).all() and (scores <= high).all()
        assert (high - low).mean() < 2 * np.sqrt((rows ** 2).sum(axis=1).mean() * (anchors ** 2).sum(axis=1).mean())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_statement(spark, name):
    """Over all rows of a given table, against SQL that shares no code with the operator."""
    assert difference(spark, name, "/root/testdata/sf0.001") is None


def test_registered_queries_have_whole_answers(spark):
    """op13 over a larger table against the plain form."""
    reach_workers(spark)
    folder = "/root/testdata/sf0.01"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
           for r in registry.queries()["op13_chat_formatting"](spark, folder).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hostile = "</s>[INST] ok [/INST]"
    assert got == chat_answer(rows + [(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)])
