"""Extraction, language, mixing, quality classifier: known cases, held-out accuracy, edge cases."""

import binascii
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmat.llm import boosting, html_text, language_id, mixing, quality_classifier
from gridmat.llm.dom import Page, join_blocks

SF = "/root/testdata/sf0.01"
LONG = "Long sentences of a story, told with many words and a few commas, fill this line. " * 2


def remainder(doc_id, n):
    return binascii.crc32(str(doc_id).encode() if doc_id is not None else b"") % n


# ------------------------------------------------------------ main text


def page_rows(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    extra = [(90001, "u", None), (90002, None, ""), (None, "u", "<p>no id"), (90003, "u", "<html><body><article><p>" + "word " * 60000 + "</article>")]
    both = pages.unionByName(spark.createDataFrame(extra, pages.schema))
    return both.withColumn("text", F.lit(1)).withColumn("x", F.lit(2))


def text_inside_article(html):
    """Blocks of the article of a generated page, read off its known template."""
    import re
    from html import unescape

    inside = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S).group(1)
    blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_main_text_of_pages(spark):
    pages = page_rows(spark)
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(out) == len(rows)
    for r in rows:
        if r.page_id is not None and r.page_id < 90000:
            assert out[r.page_id].text == text_inside_article(r.html)
    assert out[90001].text == out[90002].text == "" and out[90001].n_chars == 0
    assert out[90003].n_chars == len("word " * 60000) - 1
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert html_text.extract(pages.limit(0)).count() == 0


def test_other_page_designs(spark):
    trees = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))

    def text(html):
        page = html_text.Parsed(html)
        return page.text(trees.margin(page.features))

    cases = {
        f"<body><div class=menu><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><div id=content><h1>Head line of it</h1><p>{LONG}<p>{LONG}"
        f"<aside>note</aside><div class='sidebar'><p>{LONG}</div></div><div class='comments'><p>{LONG}</p></div><form><p>{LONG}</p></form></body>": ["Head line of it", LONG, LONG],
        f"<nav><a href=x>Go home</a></nav><article><header><h1>Title of this page</h1></header><p>{LONG}&lt;b&gt; &eacute;</p><section class='comments'><p>I like it</p></section><footer>By me</footer></article>": ["Title of this page", LONG + "<b> é"],
        f"<div><div><a href=1>a b c</a> <a href=2>d e f</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div class=footer>Copyright 2020</div></div>": [LONG, LONG],
    }
    for html, blocks in cases.items():
        assert text(html) == "\n\n".join(b.strip() for b in blocks)


def test_a_kept_node_never_lies_below_a_dropped_one():
    rng = np.random.default_rng(0)
    page = html_text.Parsed("<div><p>a<div><p>b</p><ul><li>c<li>d</ul></div></div>" * 5)
    for _ in range(200):
        kept = page.decode(rng.normal(0, 3, len(page.nodes)))
        assert all(kept[page.parent[k]] for k in range(1, len(kept)) if kept[k])


def test_reading_html():
    def blocks(html):
        page = Page(html)
        return join_blocks([(node and id(node), text) for node, text in page.pieces])

    assert blocks("<p>a<p>b<br>c</p>d &amp; e<script>if (a<b) '<p>x</p>'</script>") == "a\n\nb c\n\nd & e"
    assert blocks("<title>no</title><li>x<li>y<!-- <p>z --></ul>w") == "x\n\ny\n\nw"
    assert blocks("a <b>bold</i> text < 5 <p class='x>y'>in</p") == "a bold text < 5\n\nin"
    assert blocks("") == blocks("<!-- open") == ""


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    trees = boosting.Trees(trees=20).fit(x[:2000], y[:2000])
    assert ((trees.margin(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.97


# ------------------------------------------------------------ language


def test_language_of_held_out_documents(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id.predict(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
    edge = {r.doc_id: r for r in language_id.predict(edge_docs).collect()}
    assert [edge[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and edge[9001].score == 0
    assert language_id.predict(no_docs).count() == 0
    nothing = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict(nothing).collect()} == {"und"}


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    part = lambda lang, skip: next(r.text for r in docs.where((F.col("lang") == lang) & (F.length("text") > 600)).orderBy("doc_id").limit(skip + 1).collect()[skip:])[:400].rsplit(" ", 1)[0]
    a, b = part("de", 3), part("en", 5)
    mixed = spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string")
    spans = language_id.label(mixed, model).first().spans
    assert [s.lang for s in spans] == ["de", "en"]
    assert abs(spans[0].to_byte - len(a.encode())) < 60


def test_best_path_is_viterbi():
    rng = np.random.default_rng(4)
    for _ in range(300):
        words, kinds, switch = rng.integers(1, 9), rng.integers(1, 4), rng.uniform(0, 3)
        sizes = rng.multinomial(words, [0.5, 0.5])
        edges = np.append(0, np.cumsum(sizes))
        scores = rng.normal(size=(words, kinds))
        path = language_id.best_path(scores, edges, switch)

        def value(p, lo):
            return sum(scores[lo + i, k] for i, k in enumerate(p)) - switch * sum(x != y for x, y in zip(p, p[1:]))

        for lo, hi in zip(edges[:-1], edges[1:]):
            best = max((value(p, lo) for p in np.ndindex(*[kinds] * (hi - lo))), default=0)
            assert value(path[lo:hi], lo) == pytest.approx(best)


# ------------------------------------------------------------ mixing


def test_rates_meet_targets_and_are_a_projected_gradient(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    tokens = rng.integers(0, 900, 500)
    rows = spark.createDataFrame([(i, int(n), q.tolist()) for i, (n, q) in enumerate(zip(tokens, p))], "doc_id long, n_tokens long, posterior array<double>").repartition(4)
    weights = [1.3, 0.4, 0.1]
    gradients, total, target = mixing.fit_rates(rows, weights, steps=200)
    # The same steps in one process.
    present = tokens @ p
    r = np.ones(500)
    for _ in range(len(gradients)):
        r = np.maximum(0, r - p @ ((tokens * r) @ p - present * weights) * 0 - p @ (((tokens * r) @ p - present * np.array(weights)) / present))
    got = {x.doc_id: x.rate for x in mixing.with_rates(rows, gradients, 3).collect()}
    assert np.allclose([got[i] for i in range(500)], r)
    assert np.allclose(total, target, rtol=0.02) and min(got.values()) >= 0


def test_mixture_of_documents(spark, edge_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = mixing.mixture(docs, labels).toPandas()
    assert len(out) == docs.count()
    assert np.allclose(out.p_clean + out.p_poor + out.p_toxic, 1)
    assert ((out.copies - out.rate).abs() < 1).all() and (out.rate >= 0).all()
    seen = out.merge(labels.toPandas(), on="doc_id")
    clean, toxic = seen[(seen.quality > 0) & (seen.toxic == 0)], seen[seen.toxic > 0]
    assert (clean.copies > 0).mean() > 0.95 and (toxic.copies == 0).mean() > 0.8
    kept = mixing.mixed(edge_docs, labels)
    assert kept.columns == edge_docs.columns and kept.count() <= edge_docs.count()
    assert mixing.mixture(no_docs, labels).count() == 0
    assert mixing.mixture(edge_docs, labels.limit(0)).count() == edge_docs.count()


# ------------------------------------------------------------ quality classifier


def test_quality_of_held_out_documents(spark, edge_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_classifier.score(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.5)).all()
    assert all(h == (remainder(i, 3) == 1) for i, h in zip(out.doc_id, out.held_out))
    held = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    assert quality_classifier.score(edge_docs, labels).count() == edge_docs.count()
    assert quality_classifier.score(no_docs, labels).count() == 0
    no_label = quality_classifier.score(edge_docs, labels.limit(0)).toPandas()
    assert np.allclose(no_label.score, 0.5)


def test_word_vectors_are_sums_of_the_neighbours_index_vectors(spark):
    from gridmat.llm.common import text_buffers
    from gridmat.llm.tokens import terms
    import pyarrow as pa

    texts = ["one two three", "two one", "", "three three One!!"]
    place, sign = quality_classifier.index_vectors()
    want = np.zeros((quality_classifier.BUCKETS, quality_classifier.DIM))
    for t in texts:
        b, _ = terms(*text_buffers(pa.array([t])), quality_classifier.BUCKETS)
        for i in range(len(b)):
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if i != j:
                    for k in range(quality_classifier.NONZERO):
                        want[b[i], place[b[j], k]] += sign[b[j], k]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert np.allclose(quality_classifier.word_vectors(docs), want, atol=1e-6)


def test_terms_tell_signs_shapes_and_repeats():
    from gridmat.llm.common import text_buffers
    from gridmat.llm.tokens import terms
    import pyarrow as pa

    def bag(text):
        return Counter(terms(*text_buffers(pa.array([text])), 1 << 30)[0].tolist())

    assert bag("word!! Word!!") != bag("word!! word!!")
    assert (bag("a### b###") & bag("c### d###")).total() >= 3
    assert sum(bag("").values()) == 0 and sum(bag("#").values()) == 2
