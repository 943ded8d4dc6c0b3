"""WARC round trips, token sequences and benchmark windows."""

import base64
import collections
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from corpora import WORDS, corpus, prose
from debtatlas.llm import decontaminate, packing, registry, warc, words

PAGES = "page_id long, url string, html string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def page_rows():
    rows = [(n, f"http://a.org/{n}", f"<p>{prose(n, 30)}</p>") for n in range(30)]
    rows += [(100 + n, None, f"<p>{prose(n % 4, 30)}</p>") for n in range(12)]
    rows += [(200, "http://b.org/\r\nWARC-Type: x", None), (201, "u", ""), (202, "é", "ü\r\n\r\nWARC/1.1\r\n" * 40),
             (203, "long", prose(3, 9000) * 4), (None, "no id", "alone"), (None, "no id", "<p>two</p>"),
             (None, "no id", "<p>two</p>"), (5, "again", rows[5][2]), (5, "other", "<p>other</p>")]
    return rows


def wanted(rows):
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        best = last.get(html or "")
        response = best is None or i == best
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if response else "revisit", None if response else best))
    return collections.Counter(out)


@pytest.mark.parametrize("range_bytes", [500, 4_000, warc.RANGE_BYTES])
def test_pages_come_back(frame, tmp_path, range_bytes):
    got = warc.write_and_read(frame(page_rows(), PAGES), f"file:{tmp_path}/w", range_bytes).collect()
    assert collections.Counter(map(tuple, got)) == wanted(page_rows())


def test_a_header_of_any_length_is_read(frame, tmp_path):
    """An address that does not compress, so that the record's header alone spans several reads."""
    draw = random.Random(9)
    url = "http://a.org/" + "".join(draw.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(3 << 20))
    rows = [(1, url, "<p>x</p>"), (2, "u", "<p>y</p>")]
    got = warc.write_and_read(frame(rows, PAGES), f"file:{tmp_path}/w", 1 << 20).collect()
    assert collections.Counter(map(tuple, got)) == wanted(rows)


def test_missing_records_are_an_error(frame, tmp_path):
    manifest = warc.write_pages(frame(page_rows(), PAGES), f"file:{tmp_path}/w")
    records = warc.read_records(manifest).select("path", "record_id")
    assert warc.all_read(records, manifest).count() == len(page_rows())
    with pytest.raises(RuntimeError, match="written"):
        warc.all_read(records.where("record_id != '<urn:x-page:200>'"), manifest)


def test_records_hold_urls_and_payloads(frame, tmp_path):
    manifest = warc.write_pages(frame(page_rows(), PAGES), f"file:{tmp_path}/w")
    rows = warc.read_records(manifest, 3_000).collect()
    assert manifest.agg({"records": "sum"}).first()[0] == len(page_rows()) == len(rows)
    payloads = {r.record_id: bytes(r.payload) for r in rows if r.type == "response"}
    assert payloads["<urn:x-page:203>"] == (prose(3, 9000) * 4).encode()
    assert {r.url for r in rows} >= {"é", None, "http://b.org/%0D%0AWARC-Type: x"}
    whole = b"".join(zlib.decompress(open(r.path.removeprefix("file:"), "rb").read(), 31)[:9]
                     for r in manifest.collect())
    assert whole == b"WARC/1.1\r" * manifest.count()


def test_no_pages(frame, tmp_path):
    assert warc.write_and_read(frame([], PAGES), f"file:{tmp_path}/w").count() == 0


def test_ranges_find_each_member_once():
    draw = random.Random(4)
    data, offsets = b"", []
    for n in range(40):
        offsets.append(len(data))
        body = draw.randbytes(draw.choice([0, 40, 3000])) + warc._MAGIC * draw.randrange(4)
        packer = zlib.compressobj(draw.choice([0, 6]), zlib.DEFLATED, 31)
        data += packer.compress(warc.record_bytes(f"<urn:x-page:{n}>", "u", body, "d", None)) + packer.flush()
    for step in (97, 1000, len(data)):
        found = [at for low in range(0, len(data), step)
                 for at, _, _ in warc._scan(io.BytesIO(data), low, min(low + step, len(data)), len(data))]
        assert found == offsets


def test_a_changed_payload_is_noticed():
    record = warc.record_bytes("<urn:x-page:1>", "u", b"payload", "d", None)
    with pytest.raises(ValueError):
        warc._record_row("p", 0, record.replace(b"payload\r\n\r\n", b"pay1oad\r\n\r\n"))


TEXTS = [text for _, text in corpus()] + [
    "<|endoftext|> it's the <|startoftext|>'s I'LL we've", "İstanbul ǅ ß Σας ſ ﬁ é ́x a b c", "a\tb\r\nc\x1cd\x85e",
    "x" * 3000, "12345 6.7!? ... --- \"quoted\" (x)", "don't can't o'clock 'tis '''s", "日本語テキスト 한국어 עברית 🙂👍🏽", "_under_ ²³ ª º µ ×÷"]


def test_cached_words_give_the_tokenizers_ids():
    plain = Tokenizer.from_file(PATH)
    encoder = packing.Encoder(PATH, 2)
    for _ in range(2):
        ids, limits = encoder.encode(TEXTS)
        for n, text in enumerate(TEXTS):
            want = plain.encode(text or "", add_special_tokens=False).ids + [2]
            assert ids[limits[n]:limits[n + 1]].tolist() == want, text


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_every_word_of_a_table_has_the_tokenizers_ids(spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    vocabulary = sorted({w for t in texts for w in (t or "").split()})
    ids, limits = packing.Encoder(PATH, 2).encode(vocabulary)
    plain = Tokenizer.from_file(PATH)
    for n, found in enumerate(plain.encode_batch(vocabulary, add_special_tokens=False)):
        assert ids[limits[n]:limits[n + 1] - 1].tolist() == found.ids


def cheapest(size, inner, sentences, window):
    """The least cost by trying every pair of cuts."""
    price = {0: 0, size: 0} | {s: packing.SENTENCE_PENALTY for s in sentences} | {d: 0 for d in inner}
    price[0] = price[size] = 0
    spots = sorted(price)
    best = {0: 0}
    for j in spots[1:]:
        options = [best[i] + (0 if (j - i) & (j - i - 1) == 0 else window - (j - i))
                   for i in spots if i < j <= i + window and i in best]
        best[j] = min(options) + price[j] + packing.SEQUENCE_COST
    return best[size]


def cost(ends, size, inner, window):
    total, low = 0, 0
    for high in ends.tolist():
        assert 0 < high - low <= window
        n = high - low
        total += (0 if n & (n - 1) == 0 else window - n) + packing.SEQUENCE_COST
        total += 0 if high in inner or high == size else packing.SENTENCE_PENALTY
        low = high
    assert low == size
    return total


def test_plans_cost_least():
    draw = random.Random(1)
    for _ in range(60):
        size, window = draw.randrange(1, 400), draw.choice([16, 32, 50])
        marks = sorted(draw.sample(range(1, size + 1), min(size, max(size // 5, 1))))
        marks = sorted(set(marks) | set(range(0, size, window)[1:]))
        inner = [m for m in marks if draw.random() < 0.3]
        rest = [m for m in marks if m not in inner]
        ends = packing.plan(size, np.array(inner, np.int64), np.array(rest, np.int64), window)
        assert cost(ends, size, inner, window) == cheapest(size, inner, rest, window)


def test_a_stretch_without_marks_is_cut():
    ends = packing.plan(10_000, np.array([10_000]), np.array([], np.int64), 4096)
    assert np.diff(np.append(0, ends)).max() <= 4096 and ends[-1] == 10_000


@pytest.mark.parametrize("block", [packing.BLOCK_TOKENS, 500])
def test_pieces_hold_every_id_once(docs, block, monkeypatch):
    plain = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, window=128).collect()
    want = collections.Counter(
        (i, np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
        for i, text in corpus())
    sequences, parts = collections.defaultdict(list), collections.defaultdict(list)
    for row in got:
        assert len(row.ids) == 4 * row.length
        sequences[row.sequence_id].append(row)
        parts[row.doc_id, row.doc_tokens].append(row)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0] + [r.length for r in rows[:-1]]).tolist()
        assert sum(r.length for r in rows) == rows[0].sequence_tokens <= 128
    for (doc_id, tokens), rows in parts.items():
        copies = [ids for (i, ids), n in want.items() for _ in range(n) if i == doc_id and len(ids) == 4 * tokens]
        assert copies and sum(r.length for r in rows) == tokens * len(copies)
        if len(copies) == 1:
            rows.sort(key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in rows) == copies[0]
            assert [r.start for r in rows] == np.cumsum([0] + [r.length for r in rows[:-1]]).tolist()


def test_packing_nothing(frame):
    assert packing.pack(frame([]), PATH).count() == 0


def test_little_padding(spark):
    rows = packing.op9_packing(spark, "/root/testdata/sf0.01").select(
        "sequence_id", "sequence_tokens").distinct().collect()
    padding = sum(0 if r.sequence_tokens & (r.sequence_tokens - 1) == 0 else 4096 - r.sequence_tokens for r in rows)
    assert padding < 0.01 * sum(r.sequence_tokens for r in rows)


def leaks(rows, items, percent=80):
    out = {}
    for j, item in items:
        w = (item or "").encode().lower().split()
        if not w:
            continue
        k = min(5, len(w))
        own = collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        for i, text in rows:
            v = (text or "").encode().lower().split()
            size = min(len(w), len(v))
            grams = [tuple(v[a:a + k]) for a in range(len(v) - k + 1)]
            if not own.keys() & set(grams):
                continue
            for s in range(len(v) - size + 1):
                here = collections.Counter(grams[s:s + size - k + 1])
                like = sum((own & here).values()) / sum((own | here).values())
                if 100 * like >= percent and like > out.get((i, j), (0,))[0]:
                    out[i, j] = (like, s, size)
    return out


def items_and_rows():
    items = [(n, " ".join(prose(300 + n, 12 + 3 * n).split())) for n in range(14)]
    items += [(20, None), (21, " "), (22, "Three short words"), (23, items[4][1]), (24, "one"), (25, "echo " * 30),
              (26, " ".join(prose(900, 700).split()))]
    draw, rows = random.Random(8), [(i, text) for i, text in corpus() if i is not None and i != 70]
    for n in range(14):
        w = items[n][1].split()
        rows.append((1000 + n, prose(n, 25) + "\n" + items[n][1].upper() + " " + prose(n + 50, 15)))
        w[len(w) // 2] = "CHANGED"
        rows.append((1100 + n, prose(n + 70, 9) + " " + " ".join(w) + " end"))
        rows.append((1200 + n, " ".join(items[n][1].split()[:-draw.randrange(1, 6)])))
        rows.append((1300 + n, prose(n, 40) + " " + " ".join(items[n][1].split()[2:]) + " tail of it " + prose(n, 9)))
    rows += [(1400, "x three short words y"), (1401, "echo " * 28), (1402, items[16][1] if items[16][1] else "")]
    rows += [(1403, prose(1, 900) + " " + items[20][1] + " " + prose(2, 900)), (1404, "only one here")]
    return items, rows


@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 2_000])
def test_items_are_found_where_brute_force_finds_them(frame, item_bytes):
    items, rows = items_and_rows()
    got = decontaminate.matches(frame(rows), frame(items, "item_id long, text string"), item_bytes=item_bytes)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in got.collect()} == leaks(rows, items)
    assert len(leaks(rows, items)) > 40


def test_leaking_rows_go_and_the_rest_stays(frame):
    items, rows = items_and_rows()
    rows = rows + [(None, items[3][1]), (None, "clean " + prose(77, 40))]
    bench = frame(items, "item_id long, text string")
    kept = decontaminate.without_matches(frame(rows), bench)
    bad = {i for i, _ in leaks(rows, items)} - {None}
    left = collections.Counter(r.doc_id for r in kept.collect())
    assert left == collections.Counter([i for i, _ in rows if i not in bad and i is not None] + [None])
    assert kept.columns == frame(rows).columns


def test_query_over_documents_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows, items = ([tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()]
                   for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = registry.queries()["op8_decontamination"](spark, folder).collect()
    want = leaks(rows, items)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in got} == want and want


def test_work_follows_the_items_that_share_shingles_not_their_number():
    """Among thousands of items of one size only those that share rare shingles are looked at."""
    draw = random.Random(12)
    items = [(n, " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(30))) for n in range(3000)]
    found = decontaminate.Items(items, 5, 80)
    text = " ".join([prose(3, 400), items[7][1], prose(4, 400), items[2999][1]]).encode()
    data, limits = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    assert sorted(r[1] for r in found.search(data, limits)) == [7, 2999]
    starts, ends, first = words.split(data, limits)
    assert len(found._regions(words.hash_words(data, starts, ends, words.BYTES_LOWER), first)) <= 4


def test_blocks_cover_the_radius():
    draw = np.random.default_rng(2)
    for _ in range(300):
        flips = draw.choice(decontaminate.BITS, decontaminate.RADIUS, replace=False)
        blocks = np.bincount(flips // 16, minlength=decontaminate.BLOCKS)
        assert blocks.min() <= decontaminate.BLOCK_RADIUS


def test_no_documents_or_no_items(frame):
    items, rows = items_and_rows()
    empty = frame([], "item_id long, text string")
    assert decontaminate.matches(frame(rows), empty).count() == 0
    assert decontaminate.matches(frame([]), frame(items, "item_id long, text string")).count() == 0
