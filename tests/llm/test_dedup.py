"""Near duplicates, repeated passages and repeated lines against brute force."""

import collections
import hashlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from compare import difference
from debtatlas.llm import line_dedup, minhash, substring, words
from corpora import corpus, prose

SMALL = "/root/testdata/sf0.001"


def component_of(rows, size, percent):
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) or (
            frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, size, percent):
    rows = [row for row in corpus() if row[0] is not None]
    want = component_of(rows, size, percent)
    got = minhash.near_duplicates(docs, shingle=size, percent=percent).collect()
    assert len(got) == len(corpus())
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.n_shingles, row.component_id) == want[row.doc_id]
            assert row.kept == (row.doc_id == row.component_id)


def test_a_chain_around_a_dissimilar_centre_is_one_component(frame):
    """Each text is like its neighbours only; no centre is like all."""
    first = prose(3, 200).split()
    rows = [(1, " ".join(first))]
    for n in range(2, 40):
        first = first[:]
        first[(n * 5) % 200] = f"new{n}"
        first[(n * 5 + 1) % 200] = f"fresh{n}"
        rows.append((n, " ".join(first)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(rows), shingle=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in component_of(rows, 3, 85).items()}
    assert set(got.values()) == {1}


def test_a_link_to_a_member_that_is_no_centre_is_found(frame):
    """30 edited copies around a base that has not the least id; one text is linked to the base alone."""
    base = prose(21, 200).split()

    def edited(places, word):
        return " ".join(word + str(n) if n in places else w for n, w in enumerate(base))

    rows = [(n, edited((6 * n, 6 * n + 3), f"copy{n}x")) for n in range(1, 31)]
    rows += [(50, " ".join(base)), (60, edited((10, 50, 90, 130, 170), "far"))]
    sets = {i: {tuple(w[n:n + 3]) for n in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    assert [i for i in sets if i != 60 and 100 * len(sets[i] & sets[60]) >= 85 * len(sets[i] | sets[60])] == [50]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(rows), shingle=3, percent=85).collect()}
    assert got == {i: 1 for i in sets}


def test_query_over_documents_equals_brute_force(spark):
    folder = SMALL
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = registered.queries()["op4_minhash_near_dedup"](spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == component_of(rows, 3, 85)


def test_bands_follow_the_threshold():
    assert [minhash.rows_per_band(24, 85), minhash.rows_per_band(24, 80)] == [5, 4]


def test_texts_that_share_an_id_are_all_linked(frame):
    """Two texts have the id 1; each has a near copy, and all are one document's component."""
    one, other = prose(31, 90).split(), prose(32, 90).split()

    def edited(text):
        return " ".join([*text[:40], "edited", *text[41:]])

    rows = [(1, " ".join(one)), (1, " ".join(other)), (2, edited(one)), (3, edited(other)), (4, prose(33, 90))]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(order), shingle=3, percent=85).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, frame, monkeypatch):
    """Copies with 0 to 14 edits of one base, too far from each other for most to be linked: the
    prefix join lets out little more than the links, far from all pairs."""
    draw = np.random.default_rng(5)
    base = prose(41, 150).split()
    rows = []
    for n in range(300):
        text = base[:]
        for place in draw.choice(150, draw.integers(0, 15), replace=False):
            text[place] = f"edit{n}x{place}"
        rows.append((n, " ".join(text)))
    seen = []
    apart = minhash._apart

    def watch(members, percent):
        found = apart(members, percent)
        seen.append((members.count(), found.count()))
        return found

    monkeypatch.setattr(minhash, "_apart", watch)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(rows), shingle=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in component_of(rows, 3, 85).items()}
    members, pairs = seen[0]
    assert members > 150 and pairs < members


def test_compared_pairs_follow_the_size_of_a_group(frame, monkeypatch):
    """Copies with up to four edits of one base, the least ids with four: these are linked to few
    others, and the many links aside of them must not all be listed."""
    base = prose(43, 150).split()
    draw = np.random.default_rng(7)

    def group(size):
        rows = []
        for n in range(size):
            text = base[:]
            edits = 4 if n < size // 5 else int(draw.integers(0, 4))
            for place in draw.choice(150, edits, replace=False):
                text[place] = f"edit{n}x{place}"
            rows.append((n, " ".join(text)))
        return rows

    seen = []

    def watch(name):
        step = getattr(minhash, name)

        def counted(*given):
            pairs = step(*given)
            seen.append(pairs.count())
            return pairs

        monkeypatch.setattr(minhash, name, counted)

    watch("_apart")
    watch("_across")
    rows = group(400)
    counts = []
    for part in (rows[::2], rows):
        seen.clear()
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(part), shingle=3, percent=85).select(
            "doc_id", "component_id").collect()}
        assert got == {i: c for i, (_, c) in component_of(part, 3, 85).items()}
        counts.append(sum(seen))
    assert counts[1] < 2 * len(rows) and counts[1] <= 3 * counts[0] + 50, counts


def test_prefixes_hold_a_shared_shingle_of_every_linked_pair():
    """Of random linked sets, at least one shared shingle passes what the join asks for."""
    draw = np.random.default_rng(6)
    for percent in (80, 85):
        for _ in range(300):
            size = int(draw.integers(7, 90))
            common = draw.integers(1, 1 << 62, size).astype(np.uint64)
            sets = [np.unique(np.concatenate([common, draw.integers(1, 1 << 62, draw.integers(0, 1 + size // 9)).astype(np.uint64)]))
                    for _ in range(2)]
            n, m = map(len, sets)
            both = len(np.intersect1d(*sets))
            if 100 * both < percent * (n + m - both):
                continue
            batch = minhash.pa.RecordBatch.from_pydict({
                "member": [1, 2], "component": [1, 2], "sets": minhash.pa.array([s.tobytes() for s in sets], minhash.pa.binary())})
            counts = np.zeros(minhash.SLOTS, np.int64)
            for own in sets:
                counts += np.bincount(minhash._slot(own), minlength=minhash.SLOTS)
            rows = [r for b in minhash._prefixes(counts, percent)([batch]) for r in b.to_pylist()]
            left, right = ([r for r in rows if r["member"] == k] for k in (1, 2))
            assert any(a["shingle"] == b["shingle"] and a["n"] <= b["most"] and b["n"] <= a["most"]
                       and sum(((a[c] ^ b[c]) & (2 ** 64 - 1)).bit_count() for c in "abcd") * (100 + percent)
                       <= (100 - percent) * (a["n"] + b["n"]) for a in left for b in right)


def test_word_hashes_tell_words_apart():
    texts = [text or "" for _, text in corpus()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    limits = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, first = words.split(data, limits)
    want = [w for t in texts for w in t.encode().split()]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == want
    assert np.diff(first).tolist() == [len(t.encode().split()) for t in texts]
    hashes = words.hash_words(data, starts, ends).tolist()
    assert len(set(zip(want, hashes))) == len(set(want)) == len(set(hashes))
    grams = words.windows(np.array(hashes, np.uint64), 4).tolist()
    tuples = [tuple(want[i:i + 4]) for i in range(len(want) - 3)]
    assert len(set(zip(tuples, grams))) == len(set(tuples)) == len(set(grams))


def without_windows(rows, size=13):
    least = {}
    key = lambda i: float("inf") if i is None else i
    for i, text in rows:
        w = (text or "").encode().split()
        for n in range(len(w) - size + 1):
            gram = tuple(w[n:n + size])
            least[gram] = min(least.get(gram, float("inf")), key(i))
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for n in range(len(w) - size + 1):
            if least[tuple(w[n:n + size])] < key(i):
                gone.update(range(n, n + size))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), kept.decode()))
    return collections.Counter(out)


@pytest.mark.parametrize("room", [substring.GROUP_SUFFIXES, 300])
def test_repeated_passages(docs, room):
    got = substring.remove_repeats(docs, group_suffixes=room).collect()
    assert collections.Counter(map(tuple, got)) == without_windows(corpus())


def test_passage_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = collections.Counter((i, n, gone, hashlib.sha256(text.encode()).hexdigest())
                               for i, n, gone, text in without_windows(rows).elements())
    got = registered.queries()["op6_substring_dedup"](spark, SMALL).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_groups_hold_what_fits():
    counts = np.array([5, 0, 3, 40, 2, 2, 9])
    first, splits = substring.lay_out(counts, 10)
    assert splits.tolist() == [1, 1, 1, 4, 1, 1, 1]
    assert first[[0, 2]].tolist() == [0, 0] and first[3] == 1 and first[4] == first[5] == 5 and first[6] == 6


def test_repeated_lines_equal_the_statement(frame, spark):
    rows = [row for n, row in enumerate(corpus()) if row[0] is not None and row not in corpus()[:n]]
    got = line_dedup.without_repeats(frame(rows)).select("doc_id", "n_lines_", "n_removed_lines_", "text")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(line_dedup.OP5_SQL).fetchall()
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert sum(row[2] for row in want) > 20


def test_rows_without_id_and_repeated_rows(docs):
    got = collections.defaultdict(list)
    for row in line_dedup.without_repeats(docs).collect():
        got[row.doc_id].append(row)
    assert len(got[70]) == 2 and got[70][0].text == got[70][1].text == prose(11, 30)
    assert any(row.n_removed_lines_ > 0 for row in got[None])  # an id comes first
    assert got[60][0].text is None and got[60][0].n_lines_ == 0


def test_line_query_equals_its_statement(spark):
    assert difference(spark, "op5_line_dedup", SMALL) is None


def without_runs(rows):
    """Lines of runs of two or more lines with a word that stand earlier, outside of the run itself."""
    texts = {i: text.split("\n") for i, text in rows}
    lines = {i: [n for n, line in enumerate(t) if line.split()] for i, t in texts.items()}
    gone = {i: set() for i in texts}
    before = []
    for i in sorted(texts):
        at, before = lines[i], before + [i]
        for low in range(len(at)):
            for high in range(low + 1, min(low + 6, len(at))):
                run = texts[i][at[low]:at[high] + 1]
                for j in before:
                    for first in lines[j]:
                        if (j < i or first + len(run) <= at[low]) and texts[j][first:first + len(run)] == run:
                            gone[i].update(range(at[low], at[high] + 1))
    return {i: (len(gone[i]), "\n".join(x for n, x in enumerate(t) if n not in gone[i])) for i, t in texts.items()}


def test_fewer_boundaries_find_less_and_never_other_lines(frame):
    """With a divisor above 1 what goes is part of what goes with 1."""
    rows = [row for row in corpus() if row[0] is not None and row[0] != 70]
    rows += [(2000 + n, "\n".join([f"own {n}"] + [f"shared line {k}" for k in range(30)] + [f"end {n}"])) for n in range(4)]
    whole, some = ({r.doc_id: r.n_removed_lines_ for r in line_dedup.without_repeats(frame(rows), divisor=d).collect()} for d in (1, 3))
    assert all(some[i] <= whole[i] for i in whole) and 0 < sum(some.values()) < sum(whole.values())
    assert [whole[2000 + n] for n in range(4)] == [0, 30, 30, 30] and some[2003] > 10


def test_columns_called_like_the_counts_stay(frame):
    text = "a b\nc d\ne f"
    got = line_dedup.without_repeats(frame([(1, text), (2, text)])).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_removed_lines, r.n_lines_, r.n_removed_lines_) for r in got] == [("x", "x", 3, 0), ("x", "x", 3, 3)]


def test_blocks_of_two_to_six_lines_go_in_any_context(spark, frame):
    blocks = [[f"block {size} line {n} of it" for n in range(size)] for size in range(2, 7)]
    blocks[2][1] = ""
    rows = []
    for doc in range(12):
        text = [f"own {doc} start", "menu"]
        for n, block in enumerate(blocks):
            text += block + [f"own {doc} after {n}"] + ["", "menu"] * (doc % 2)
        rows.append((doc, "\n".join(text)))
    rows += [(20, "same\nsame\nsame"), (21, "x y\nz\nx y\nz\nx y\nz")]
    got = line_dedup.without_repeats(frame(rows)).collect()
    want = without_runs(rows)
    assert {r.doc_id: (r.n_removed_lines_, r.text) for r in got} == want
    assert all(want[doc][0] >= 20 for doc in range(1, 12)) and want[20][1] == "same\nsame\nsame"
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, text, "en", "s", len(text)) for i, text in rows], columns)
    assert line_dedup.without_repeats(frame(corpus())).count() == len(corpus())
    cut = corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in cut} == {i: text for i, (_, text) in want.items() if text.split()}


@pytest.mark.parametrize("run", [
    minhash.near_duplicates, substring.remove_repeats, line_dedup.without_repeats])
def test_empty_table(frame, run):
    assert run(frame([])).count() == 0
