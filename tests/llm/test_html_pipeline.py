"""Main texts, and the pipeline stage by stage."""

import numpy as np
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from corpora import corpus, prose
from debtatlas.llm import html_extract
from debtatlas.llm.common import settle
from test_dedup import component_of
from test_rules_shards_urls import JUNK, counts
from test_warc_packing_leaks import leaks


def texts_of(page):
    return [text for _, text, _ in html_extract.blocks(page)]


@pytest.mark.parametrize("page, want", [
    ("", []), ("  \n ", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>a<b>b</b>c <i>d</i>\n\n e<p>f", ["abc d e", "f"]),
    ("<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- <p>no</p> --><title>t</title>", ["x"]),
    ("<p title='a>b'>q<br>r</p>", ["q r"]), ("<p>&lt;b&gt; &eacute;&#233;&#xe9; &nbsp;x", ["<b> ééé x"]),
    ("<p>cut <a href='", ["cut"]), ("<a title=\"x>link</a> y", ["link y"]), ("<p>open <script>never", ["open"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
    ("<p>a <svg class='i'/> b</p><p>c", ["a b", "c"]), ("x<svg><path d='1'/><text>no</text></svg>y<SVG\n/>z", ["xyz"]),
    ("</p></div>x<div>y", ["x", "y"]), ("<TABLE><TR><TD>1<TD>2</TABLE>", ["1", "2"]),
])
def test_blocks(page, want):
    assert texts_of(page) == want


def test_paths_and_links():
    found = html_extract.blocks("<div class='Side-Bar x' id=q><p><a href=1>link</a> text</p></div><p>z")
    assert found == [(("div", ".side", ".bar", ".x", ".q", "p", "a"), "link text", 4), (("p",), "z", 0)]


def test_gradients_are_those_of_the_loss():
    pages = [[(("p",), "a b c", 0), (("nav", "li"), "d", 1), (("p",), "e f.", 0)], [(("div",), "x", 0)]]
    model = html_extract.Labeller()
    model.weights = {name: value.astype(np.float64) for name, value in model.weights.items()}
    rows = html_extract.features(pages).astype(np.float64)
    lengths, labels = np.array([3, 1]), np.array([1.0, 0, 1, 0])
    _, found = model.gradients(rows, lengths, labels)
    draw = np.random.default_rng(0)
    for name, value in model.weights.items():
        for at in draw.integers(value.size, size=3):
            keep = value.flat[at]
            losses = []
            for step in (1e-2, -1e-2):
                value.flat[at] = keep + step
                losses.append(model.gradients(rows, lengths, labels)[0])
            value.flat[at] = keep
            assert abs((losses[0] - losses[1]) / 2e-2 - found[name].flat[at]) < 2e-4


@pytest.fixture(scope="module")
def trained(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").select("html").limit(420).collect()
    pages = [r.html for r in rows]
    return html_extract.train(pages[:html_extract.SAMPLE_PAGES]), pages[html_extract.SAMPLE_PAGES:]


def test_held_out_layouts(trained):
    model, pages = trained
    draw = np.random.default_rng(50)
    made = [layout for page in pages[:150] for layout in html_extract.layouts(html_extract.blocks(page), draw, 4)]
    chance = model.probabilities(html_extract.features([b for b, _ in made]), np.array([len(b) for b, _ in made]))
    assert ((chance > 0.5) == np.concatenate([marks for _, marks in made])).mean() > 0.99


def test_held_out_pages_are_whole(trained):
    model, pages = trained
    for page, got in zip(pages, html_extract.main_texts(model, pages)):
        found = html_extract.blocks(page)
        assert got == " ".join(t for (_, t, _), mark in zip(found, html_extract.marked(found)) if mark)


def test_context_decides(trained):
    """The very same block, with the same path, is article text among an article's paragraphs and none
    among link lists and notices: only what stands around it differs."""
    model, pages = trained
    found = html_extract.blocks(next(p for p in pages if sum(html_extract.marked(html_extract.blocks(p))) > 8))
    own = [text for (_, text, _), mark in zip(found, html_extract.marked(found)) if mark][:9]
    path = ("div", "p")
    block = (path, own[4][:60], 0)
    article = [(path, text, 0) for text in own[:4]] + [block] + [(path, text, 0) for text in own[5:]]
    asides = [(("nav", "ul", "li", "a"), word, len(word)) for word in ("Home", "News", "About")]
    clutter = asides + [(("div", ".cookie"), "We use cookies", 0), block, (("div", ".comment", "p"), own[1], 0),
                        (("footer", "p"), "Imprint", 0)]
    chance = model.probabilities(html_extract.features([article, clutter]), np.array([len(article), len(clutter)]))
    among_text, among_clutter = chance[4], chance[len(article) + 4]
    assert among_text > 0.5 > among_clutter


def test_nothing_to_read_gives_nothing(trained):
    model, _ = trained
    assert html_extract.main_texts(model, [None, "", "<nav><a>Home</a></nav>"]) == ["", "", ""]


def test_blocks_take_time_in_proportion():
    """A paragraph of very many inline tags: twice the tags, about twice the time."""
    import time

    def seconds(tags):
        start = time.perf_counter()
        html_extract.blocks("<p>" + "<b>x</b> " * tags)
        return time.perf_counter() - start

    seconds(1000)
    assert min(seconds(40_000) for _ in range(3)) < 8 * min(seconds(10_000) for _ in range(3))


def test_copies_of_few_pages_still_teach_the_labeller(spark, frame):
    """Thousands of copies of five pages: all are drawn, and each text is its page's own article."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").select("html").limit(5).collect()
    pages = [(1000 * n + k, "u", row.html) for n, row in enumerate(rows) for k in range(400)]
    got = {r.page_id: r.text for r in html_extract.extract(frame(pages, "page_id long, url string, html string")).collect()}
    for n, row in enumerate(rows):
        found = html_extract.blocks(row.html)
        want = " ".join(t for (_, t, _), mark in zip(found, html_extract.marked(found)) if mark)
        assert {got[1000 * n + k] for k in range(400)} == {want}


def test_without_a_marked_page_a_rule_decides(frame):
    page = "<nav><ul><li><a>Menu</a></li></ul></nav><div><p>Text of it.</p></div><footer>Imprint</footer>"
    got = html_extract.extract(frame([(1, "u", page), (2, "u", None)], "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(1, "Text of it."), (2, "")}


def test_batches_do_not_change_the_verdict(trained):
    model, pages = trained
    found = [html_extract.blocks(page) for page in pages[:60]]
    rows, lengths = html_extract.features(found), np.array([len(x) for x in found])
    assert np.allclose(model.probabilities(rows, lengths), model.probabilities(rows, lengths, padded=50), atol=1e-5)


def test_extract(frame, trained):
    model, pages = trained
    rows = [(n, f"u{n}", page) for n, page in enumerate(pages[:20])] + [
        (50, None, None), (51, "", ""), (None, "x", pages[0]), (3, "u3", pages[3]),
        (60, "long", "<article><p>" + prose(1, 40_000) + "</p></article>")]
    got = html_extract.extract(frame(rows, "page_id long, url string, html string"), model=model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r for r in got}
    assert by_id[50].text == by_id[51].text == "" and by_id[60].text == " ".join(prose(1, 40_000).split())
    assert html_extract.extract(frame([], "page_id long, url string, html string")).count() == 0


# --- the pipeline ---------------------------------------------------------------------

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def whole(rows):
    return [(i, text, "en", "s", None if text is None else len(text)) for i, text in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    items = [(n, " ".join(prose(600 + n, 30).split())) for n in range(4)]
    rows = [row for row in corpus() + JUNK if row[0] not in (70, 2)]
    rows += [(800 + n, prose(700 + n, 30) + "\n" + items[n][1] + "\n" + prose(720 + n, 30)) for n in range(4)]
    spark.createDataFrame(whole(rows), COLUMNS).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place), rows, items


def test_every_stage_does_what_brute_force_does(spark, folder):
    place, rows, items = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near-duplicate removal", "benchmark decontamination", "packing"]

    def run(name, docs):
        out = settle(stages[name](spark, docs, place))
        return out, [tuple(r) for r in out.select("doc_id", "text").collect()] if "text" in out.columns else None

    good, kept = run("quality rules", docs)
    assert {i for i, _ in kept} <= {i for i, text in rows if not counts(text)[5]}
    assert {i for i, _ in kept} >= set(range(11, 30)) and not {i for i, _ in kept} & set(range(200, 205))
    cut, short = run("line dedup", good)
    assert cut.columns == docs.columns and cut.where("n_chars != length(text)").count() == 0
    assert {i for i, _ in short} <= {i for i, _ in kept} and all(text.split() for _, text in short)
    one, single = run("near-duplicate removal", cut)
    named = [(i, text) for i, text in short if i is not None]
    components = component_of(named, 5, 80)
    assert sorted(i for i, _ in single if i is not None) == sorted(i for i, (_, c) in components.items() if i == c)
    clean, left = run("benchmark decontamination", one)
    hit = {i for i, _ in leaks([(i, t) for i, t in single], items)}
    assert hit and {i for i, _ in left} == {i for i, _ in single} - hit
    packed, _ = run("packing", clean)
    assert packed.agg({"length": "sum"}).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(
        {"doc_tokens": "sum"}).first()[0]


def test_run_is_its_stages(spark, folder):
    place, _, _ = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, place))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, place).select(*key).collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.select(*key).collect()))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_ten_and_the_pipeline_are_registered():
    names = list(registered.queries())
    assert [sum(name.startswith(f"op{n}_") for name in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names
