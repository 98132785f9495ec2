"""Classifiers, page text and the pipeline."""

import random
import re

import numpy as np
import pytest
from conftest import DATA
from oracle import differences
from pyspark.sql import functions as F

from retrieval_jobs.llm import page_text, preference, queries, toxicity
from retrieval_jobs.llm.common import held_out, table
from retrieval_jobs.llm.labelled import training_sample


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("name", "label", "least"), [("op2_preference_quality", "quality", 0.95), ("op10_ngram_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").toPandas()
    own = rows[rows.held_out]
    assert rows.score.between(0, 1).all()
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert (own.predicted == own[label]).mean() >= least
    assert auc(own.score.values, own[label].values) >= 0.95
    assert len(queries.QUERIES[name](spark, sf_dir).select("doc_id").distinct().collect()) == table(spark, sf_dir, "documents").count()


def plain_statistics(text):
    raw, words = text.encode("utf-8", "surrogatepass"), text.split()
    lines = [x for x in text.split("\n") if x]
    n, count = max(1, len(raw)), max(1, len(words))
    share = lambda test: sum(map(test, raw)) / n
    upper, lower, digit = (share(lambda b, a=a, z=z: ord(a) <= b <= ord(z)) for a, z in ("AZ", "az", "09"))
    usual, wide = share(lambda b: chr(b) in ".,;:?"), share(lambda b: b > 127)
    symbols = len(raw) and share(lambda b: b < 128 and not chr(b).isalnum() and chr(b) not in ".,;:? \n") or 1 - len(raw) / n
    return upper, lower, digit, usual, wide, symbols, len(set(words)) / count, max((words.count(w) for w in set(words)), default=0) / count, len(set(lines)) / max(1, len(lines)), sum(len(w) <= 3 for w in words) / count


def test_quality_scores_are_plain_ones(spark):
    docs, labels, rows = small(spark)
    model = preference.train_quality(docs, labels, F.col("doc_id") >= 0)
    got = sorted(((r.doc_id, r.text, r.quality_score) for r in preference.with_quality(docs, model).collect()), key=str)
    for _, text, score in got:
        text = text or ""
        names = dict(zip(("upper", "lower", "digit", "usual", "wide", "symbols", "distinct", "most", "lines", "short"), plain_statistics(text), strict=True))
        own = preference.text_statistics(text)
        for place, name in ((3, "upper"), (4, "digit"), (5, "usual"), (6, "symbols"), (7, "wide"), (8, "distinct"), (9, "most"), (10, "lines"), (13, "short")):
            assert own[place] == pytest.approx(names[name], abs=1e-9), name
        raw_bytes, hashed = text.encode(), [0] * preference.HASHED
        for k in range(len(raw_bytes) - 2):
            hashed[(int.from_bytes(raw_bytes[k : k + 3], "little") * 2654435761 & 0xFFFFFFFF) >> 24] += 1
        assert own[preference.MEASURES :].tolist() == pytest.approx([np.sqrt(x / max(1, len(raw_bytes))) for x in hashed])
        z = [max(-6, min(6, (x - c) / s)) for x, c, s in zip(own, model.center, model.scale, strict=True)]
        first, rest = z[: preference.MEASURES], z[preference.MEASURES :]
        parts = [*first, *(preference.HASHED_SCALE * x for x in rest), *(x * x for x in first)]
        raw = sum(w * x for w, x in zip(model.weights, parts, strict=True)) - model.threshold
        assert score == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, raw)))), abs=1e-9)


def plain_grams(text):
    codes = [ord(c) for c in " " + " ".join(text.lower().split()) + " "]
    full, out = (1 << 32) - 1, set()
    for n in range(3, 7):
        for k in range(len(codes) - n + 1):
            h = codes[k]
            for c in codes[k + 1 : k + n]:
                h = (h * 0x9E3779B1 & full) ^ (c * 0x85EBCA6B & full)
                h ^= h >> 15
            out.add((h * 0xC2B2AE35 + n & full) >> 12)
    return out


def test_toxicity_scores_are_plain_ones(spark):
    docs, labels, rows = small(spark)
    docs = docs.where("doc_id is null or doc_id <> 102")
    model = toxicity.train_toxicity(docs, labels, F.col("doc_id") >= 0)
    sample = training_sample(docs, labels, "toxic", F.col("doc_id") >= 0).collect()
    grams, marks = [plain_grams(r.text) for r in sample], [r.label for r in sample]
    ones, zeros = sum(marks), len(marks) - sum(marks)

    def certainty(g):
        a, b = (sum(g in x for x, m in zip(grams, marks, strict=True) if m == k) + 0.5 for k in (1, 0))
        return abs(np.log(a / b) - np.log((ones + 1) / (zeros + 1))) / np.sqrt(1 / a + 1 / b)

    chosen = {g for g in set().union(*grams) if certainty(g) > 2}
    assert len(chosen) < toxicity.FEATURES
    assert set(np.flatnonzero(model.place >= 0).tolist()) == chosen
    for r in toxicity.with_toxicity(docs, model).collect():
        own = [model.place[g] for g in plain_grams(r.text or "") if model.place[g] >= 0]
        raw = sum(model.weights[k] for k in own) / np.sqrt(len(own) + 1) + model.bias
        assert r.toxicity_score == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, raw)))), abs=1e-9)


def small(spark):
    random.seed(1)
    rows, labels = [], []
    for k in range(60):
        bad = k % 3 == 0
        words = ["you", "utter", "zorgle" if bad else "flower"] + random.choices(["tree", "sky", "walk", "quiet"], k=20)
        rows.append((k, " ".join(words) + ("!!! $$$ ### " * 5 if bad else ". "), "q", 0.5, 7))
        labels.append((k, 0 if bad else 1, 1 if bad else 0))
    rows += [(100, None, None, None, None), (101, "", "q", 0.1, 1), (102, "word " * 50_000, "q", 0.1, 1), (None, "x", "q", 0.1, 1), (3, rows[3][1], "q", 0.2, 1)]
    labels += [(0, None, None), (1, 1, 0), (None, 1, 1), (2, 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, quality_score double, toxicity_score int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


@pytest.mark.parametrize(("train", "use", "column", "label"), [(preference.train_quality, preference.with_quality, "quality_score", 1), (toxicity.train_toxicity, toxicity.with_toxicity, "toxicity_score", 0)])
def test_classifier_edges(spark, train, use, column, label):
    docs, labels, rows = small(spark)
    model = train(docs, labels, F.col("doc_id") >= 0)
    got = use(docs, model).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.doc_id is not None and r.doc_id < 60 and (r[column] >= 0.5) != ((r.doc_id % 3 != 0) == bool(label))} == set()
    assert all(0 <= r[column] <= 1 for r in got)
    assert use(docs.where("doc_id < 0"), model).count() == 0
    for part, want in ((labels.where("doc_id < 0"), None), (labels.where("quality = 1"), None)):
        scores = {r[column] for r in use(docs, train(docs, part, F.col("doc_id") >= 0)).collect()}
        assert len(scores) == 1
        assert want is None or scores == want


def test_training_rows_are_bounded_and_allowed(spark):
    docs, labels, _ = small(spark)
    assert training_sample(docs, labels, "quality", ~held_out(F.col("doc_id"), 3, 1), rows=10).count() <= 11
    allowed = training_sample(docs, labels, "toxic", F.col("doc_id") < 6).collect()
    assert len(allowed) == 7  # doc 3 stands there twice


FRAME = '<html><head><title>T</title></head><body><div class="top"><p>Our site</p></div>{}<div>Call us</div><script>var a="<p>no</p>";</script></body></html>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>A&amp;B</h1><p>x <b>y</b>\n z<br>w</p></article>", ["A&B", "x y z w"]),
        ("<nav>menu</nav><article><p>one</p><aside>no</aside><p>two<footer>f</footer></article><footer>f</footer>", ["one", "two"]),
        ("<article><div class='comments'><p>c</p></div><p>kept</p><form><p>f</p></form></article>", ["kept"]),
        ("<nav>never closed<article><p>in</p>", ["in"]),
        ("<form><div>all</div><main><p>in a form</p></main></form>", ["all", "in a form"]),
        ('<body><form id="aspnetForm"><div><h1>T</h1><p>whole story</p><label>Name</label><input name="q"><button>Go</button><select><option>one</option></select></div></form></body>', ["T", "whole story"]),
        ("<p>A story of some length</p><form><label for='e'>Mail</label><p>Sign here</p></form>", ["A story of some length"]),
        ("<article><section class='related-work'><p>a</p></section><section class='topic social-science'><p>b</p></section><section id='search-for-life'><p>c</p></section></article>", ["a", "b", "c"]),
        ("<div class='sidebar-left'><p>menu</p></div><div class='share-left'>x</div><div class='site-footer'>y</div><ul class='nav__items-2'><li>z</ul><p>text</p>", ["text"]),
        ("<article><p>a < b & c &lt; d</p><!-- <p>no</p> --><p title='x>y'>e", ["a < b & c < d", "e"]),
        ("<article><header><h2>head</h2></header>t</article>", ["head", "t"]),
        ("plain text only", ["plain text only"]),
        ("", []),
        ("<article>" + "<p>long</p>" * 3000 + "</article>", ["long"] * 3000),
        ('<article><p>one <a class="share" href="x">tw</a> two</p><p>three</p></article>', ["one two", "three"]),
        ('<p>a <a class="related" href="x">no <b>none</b></a>b</p><p>c <span class="ad">no</span></p><p>d <span id="search">e</span></p>', ["a b", "c", "d e"]),
        ('<p>a <a class="ad">never closed</p><p>b</p>', ["a", "b"]),
        ("<section class='comments'><article class='comment'><p>reader says</p></article></section><p>text</p>", ["text"]),
        ("<div id='comments'><article>reader</article></div><aside class='related'><article>teaser</article></aside><p>x</p>", ["x"]),
        ("<article class='comment'>reader</article><article class='post no-comments'>mine</article>", ["mine"]),
        ("<div class='page with-sidebar'><p>k</p></div><div class='left sidebar'>no</div>", ["k"]),
        ("<p>a<p>b<ul><li>c<li>d<ul><li>e</ul></ul><p>f<script>x</script>g</p>", ["a", "b", "c", "d", "e", "fg"]),
        ("<h2 id='search'>Search</h2><div id='search'>no</div>", ["Search"]),
    ],
)
def test_page_lines(page, want):
    assert [line for line, _, _ in page_text.page_lines(page)] == want


def test_lines_know_their_place():
    page = FRAME.format("<nav><li>menu</li></nav><main><p>m</p><article><p>open</p></article></main><footer>foot</footer>")
    lines = page_text.page_lines(page)
    assert [(line, zone) for line, _, zone in lines] == [("Our site", 0), ("m", 1), ("open", 3), ("Call us", 0)]
    again = page_text.page_lines(page.replace("Our site", "Another").replace("<p>m</p>", "<p>m</p><p>n</p>"))
    slots, other = [slot for _, slot, _ in lines], [slot for _, slot, _ in again]
    assert len(set(slots)) == 4 and other == [slots[0], slots[1], slots[1], *slots[2:]]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><h1>T</h1><p>long body</p><section><article><h3>teaser</h3></article></section></main><p>out</p>", ["T", "long body", "teaser"]),
        ("<p>out</p><main><p>lead</p><article>body</article><p>tail</p></main>", ["lead", "body", "tail"]),
        ("<p>out</p><article>one body</article><article>two</article>", ["one body", "two"]),
        ("<h1>Title</h1><p>" + "long body " * 30 + "</p><article>teaser</article>", ["Title", ("long body " * 30).strip(), "teaser"]),
    ],
)
def test_main_lines(page, want):
    lines = page_text.page_lines(page)
    assert [x for (x, _, _), kept in zip(lines, page_text.main_lines(lines), strict=True) if kept] == want


BROKEN = ["<a ", '<a x="', "<a x='>\"", "<nav>", "<nav><article>", "<div>", "<div>x", "<b><i class=ad>", "<i class=ad></b>", "<li><ul><div>", "<p><table><div>", "<form><label>", "<!-- ", "<script>", "</div>", "<td><dl><dt>", "< ", "<!", "<article>t</p>", "<p>a<br>"]


@pytest.mark.parametrize("part", BROKEN)
def test_broken_pages_take_time_in_proportion(part):
    import time

    page = "<article>text " + part * (1_000_000 // len(part)) + "<li>a<td>b<p>c"
    began = time.process_time()
    lines = page_text.page_lines(page)
    assert time.process_time() - began < 8
    assert lines or part in ("<nav>", "<script>", "<!-- ") or lines == []


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("size", [1 << 24, 100])
def test_shared_lines_are_longest(monkeypatch, size):
    monkeypatch.setattr(page_text, "LCS_BYTES", size)
    random.seed(9)
    for _ in range(300):
        a, b = (random.choices("abcde", k=random.randrange(14)) for _ in range(2))
        got = page_text.shared_lines(a, b)
        assert got == sorted(set(got))
        assert len(got) == plain_lcs(a, b)
        rest = iter(b)
        assert all(any(x == a[k] for x in rest) for k in got)


def test_long_and_unbalanced_pages_take_little_time():
    import time

    began = time.process_time()
    assert len(page_text.shared_lines(["x"] * 20_000 + ["y"], ["z"] + ["x"] * 10_000)) == 10_000
    assert len(page_text.page_lines("<div>" * 5_000 + "deep" + "<p>line" * 20_000)) == 20_001
    assert page_text.shared_lines(["a"], [str(k) for k in range(100_000)] + ["a"]) == [0]
    assert time.process_time() - began < 20


def texts_of(spark, rows):
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, row string, gone int, host string").repartition(5)
    got = page_text.main_text(pages).collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_differencing(spark):
    rows = [(k, f"http://{'abc'[k % 3]}.example/d{k % 2}/p{k:02}", FRAME.format(f"<p>own text {k}</p>" if k % 4 else f"<article>art {k}</article>")) for k in range(40)]
    rows += [(100, None, None), (101, "http://solo.example/", FRAME.format("<p>alone</p>")), (102, "http://[bad", ""), (5, rows[5][1], rows[5][2])]
    got = texts_of(spark, rows)
    for k, text in got.items():
        if k == 101:
            assert text == "Our site\n\nalone\n\nCall us"
        elif k >= 100:
            assert text == ""
        else:
            assert text == (f"own text {k}" if k % 4 else f"art {k}")
    assert page_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_text_follows_the_neighbours(spark):
    """One page, without any marks, beside different neighbours: its text is what it doesn't share with them."""
    page = "<body><div>Frame one</div><div>Story of the day</div><div>Frame two</div></body>"
    url = "http://h.example/news/5"
    alone = texts_of(spark, [(5, url, page)])[5]
    assert alone == "Frame one\n\nStory of the day\n\nFrame two"
    frames = [(k, f"http://h.example/news/{k}", page.replace("Story of the day", f"Story {k}")) for k in (1, 2, 3, 9)]
    assert texts_of(spark, [(5, url, page), *frames])[5] == "Story of the day"
    others = [(k, f"http://h.example/news/{k}", f"<body><div>Other {k}</div><div>Story of the day</div><div>Else {k}</div></body>") for k in (1, 2, 3, 9)]
    assert texts_of(spark, [(5, url, page), *others])[5] == "Frame one\n\nFrame two"


def test_copies_and_common_passages_stay(spark):
    """Copies of a page are no neighbours of it; a passage of a few articles is theirs, and stays."""

    def page(k, lines):
        return "<body><div>Home of h</div><main>" + "".join(f"<p>{x}</p>" for x in lines) + f"</main><div>Imprint</div><div>note {k % 3}</div></body>"

    own = {k: [f"line {k} {n}" for n in range(8)] for k in range(12)}
    for k in (3, 4, 7):
        own[k][2:4] = ["a passage that three articles have", "and its second line"]
    rows = [(k, f"http://h.example/a/{k:02}", page(k, x)) for k, x in own.items()]
    rows += [(100 + k, f"http://h.example/a/03-{k:02}", rows[3][2]) for k in range(20)]
    got = texts_of(spark, rows)
    assert got == {i: "\n\n".join(own[3 if i >= 100 else i]) for i in got}


def test_pages_of_the_tables(spark):
    rows = table(spark, DATA, "pages").collect()
    got = {r.page_id: r.text for r in queries.QUERIES["op5_url_differencing"](spark, DATA).collect()}
    import html

    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(x for x in lines if x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name], DATA) is None


def test_pipeline(spark):
    import corpus_pipeline
    from test_near import plain_components, plain_lines, plain_set

    docs = table(spark, DATA, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DATA).persist()
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == before.columns
    model = preference.train_quality(table(spark, DATA, "documents"), table(spark, DATA, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    before, after = seen["quality"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if model.scores(np.array([preference.text_statistics(r.text or "")]))[0] >= 0.5}
    before, after = seen["toxicity"]
    assert {r.doc_id for r in after} < {r.doc_id for r in before}
    before, after = seen["lines"]
    want = {r[0]: r for r in plain_lines([(r.doc_id, r.text, r.source) for r in before], 10, 20)}
    assert {r.doc_id: r.text for r in after} == {i: w[1] for i, w in want.items() if not w[3] or w[1].strip(" ")}
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_copies"]
    sets = {r.doc_id: plain_set(r.text, 5) for r in before}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in after} == {i for i, c in plain_components(ids, linked).items() if i == c}
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert sum(r.length for r in after) == sum({r.doc_id: r.doc_tokens for r in after}.values())
    # how documents are cut depends on the number of tasks, but not what is packed
    assert {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, DATA).collect()} == {(r.doc_id, r.doc_tokens) for r in after}


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_edges(spark, stage):
    """Nulls, empty and very long texts, ties and repeated rows, clashing columns, an empty table: as the stages' docstrings say."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    clean = [r.text for r in table(spark, DATA, "documents").join(table(spark, DATA, "labels").where("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").limit(40).collect()]
    rows = [(k, t, "en", "s1", len(t), "x", 1.0, 2, "y") for k, t in enumerate(clean)]
    rows += [(100, None, None, None, None, None, None, None, None), (101, "", "en", "s2", 0, "x", 1.0, 2, "y"), (102, (clean[0] + " ") * 60, "en", "s2", 0, "x", 1.0, 2, "y"), (None, clean[1], "en", "s3", 5, "x", 1.0, 2, "y")]
    rows += [rows[2], (103, clean[2], "en", "s4", 5, "x", 1.0, 2, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, toxicity_score double, n_removed int, kept string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    out = run(spark, docs, DATA).collect()
    ids = [r.doc_id for r in out]
    if name == "packing":
        assert set(ids) == {r[0] for r in rows}
        assert all(r.length == 1 for r in out if r.doc_id in (100, 101))
    else:
        assert list(out[0].asDict()) == docs.columns
        assert {(r.quality_score, r.toxicity_score, r.n_removed, r.kept) for r in out if r.doc_id != 100} == {("x", 1.0, 2, "y")}
    if name == "lines":
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows)
    if name == "near_copies":
        assert 103 not in ids and ids.count(2) == 2 and ids.count(None) == 1 and {100, 101} <= set(ids)
    empty = run(spark, docs.where("doc_id = -5"), DATA)
    assert empty.count() == 0
