"""Operators that have no plain twin, and the cases that every operator has to bear."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm.common import prepare
from tallybook.llm.decontaminate import decontaminate
from tallybook.llm.exact_dedup import exact_dedup
from tallybook.llm.html_extract import extract
from tallybook.llm.licences import known_licences, scan_licences
from tallybook.llm.mixing import fit_rates, mix_sources
from tallybook.llm.quality import fit_forest, quality_scores
from tallybook.llm.queries import QUERIES, RULES
from tallybook.llm.simhash import simhash_dedup
from tallybook.llm.substring_dedup import substring_dedup
from tallybook.llm.suffix_dedup import suffix_array, suffix_dedup
from tallybook.llm.url_filter import filter_urls
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
RULE_SCHEMA = "host string, path string, verdict string"


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for stop in "/?#":
        host = host.split(stop)[0]
    path = rest[len(host):]
    for stop in "?#":
        path = path.split(stop)[0]
    host = host.translate(brute.ASCII_LOWER)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return (url, host, path, best[2], best[3])


@pytest.mark.parametrize("rules", [RULES, [], RULES + [(f"h{i}.org", f"/{i % 7}/", "block") for i in range(3000)] + [("org", "", "block")]])
def test_url_filter(spark, rows_of, rules):
    rng = random.Random(2)
    hosts = ["example.com", "www.Example.COM", "a.b.net", "net", "com", "xcom", "h17.org", "sub.h2999.org", "", "user@h5.org:80"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/fr/x', '/es/?q=/en/', '/3/a#b', '?x=/en/', '#/en/'])}" for _ in range(300)]
    urls += [None, "", "no scheme/en/", "a://b://c/en/", "://"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = rows_of(filter_urls(pages, spark.createDataFrame(rules, RULE_SCHEMA)), "url", "host", "path", "rule", "verdict")
    assert got == {judged(u, rules) for u in urls}


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out")
    n, right = scored.agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 60 and right / n > 0.95


def test_quality_without_usable_labels(spark, frame):
    prepare(spark)
    labels = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    scores = [r.score for r in quality_scores(frame([(1, "a b"), (2, None), (None, "")]), labels).collect()]
    assert scores == [0.5] * 3


def test_forest_learns_a_rule():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(2000, 5)).astype(np.float32)
    marks = ((rows[:, 0] > 0.3) ^ (rows[:, 3] < 0)).astype(float)
    forest = fit_forest(rows[:1500], marks[:1500])
    assert ((forest.score(rows[1500:]) > 0.5) == marks[1500:]).mean() > 0.95


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(40):
        size = rng.choice([1, 2, 5, 40, 300])
        text = np.array([rng.randint(1, rng.choice([1, 2, 5])) for _ in range(size)] + [0], np.uint16)
        assert suffix_array(text, 1 << 20).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{x}}</style></head><body><nav><a href="/">Home</a> menu</nav>
<!-- <p>no</p> --><div class="ad-banner">Buy</div><header>Site</header><main class="content-7"><h1>Head &amp; line</h1><p>One  <b>two</b>three<br>four
<p>Five&nbsp;six &lt;b&gt;<script>var a = "<p>bad</p>";</script><aside>side</aside><form><input value="v">send</form>
<ul><li>item<li>next</ul>{body}<section id="comments"><p>A reader said {body}</p></section></main><div class="sidebar"><p>links</p></div>
<footer>&copy; all</footer></body></html>"""


def test_extraction(spark, rows_of):
    body = "Long text of the article. " * 20
    want = " ".join(f"Head & line One twothree four Five six <b> item next {body}".split())
    pages = [(i, f"https://a.org/{i}", PAGE.format(body=body)) for i in range(4)]
    # most of this page's words are not in its article, but the host's path is known
    pages.append((9, "https://A.org/9", "<body><div class='content-x'>" + "other words " * 300 + "</div><main class='content-8'><p>short</p></main>"))
    pages += [(10, None, None), (11, "x", ""), (12, "https://b.org", "plain text only"), (13, "https://c.org", "<p>a<p>b<div>c</div")]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, path string")
    got = dict(rows_of(extract(frame), "page_id", "text"))
    assert [got[i] for i in range(4)] == [want] * 4
    assert got[9] == "short" and got[10] == got[11] == "" and got[12] == "plain text only" and got[13] == "a b c"
    assert all(n == len(t) for t, n in rows_of(extract(frame), "text", "n_chars"))


def test_licences(spark, frame, rows_of):
    texts = [
        (1, "Released under the MIT License."), (2, "Copyright (c) 2020 A. Person\nreleased UNDER the mit licence!"), (3, "x\nLicensed under CC BY-NC 4.0\ny"),
        (4, None), (5, ""), (6, "Copyright 2020"), (7, "Released under the MIT License. Not."), (8, "Licenced under the Apache Licence, ver 2.0\n\nReleased under the MIT License"),
    ]
    got = rows_of(scan_licences(frame(texts), known_licences(spark)), "doc_id", "whole", "n_lines", "licences")
    assert got == {
        (1, "MIT", 1, "MIT"), (2, "MIT", 1, "MIT"), (3, None, 1, "CC-BY-NC-4.0"), (4, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""), (7, None, 0, ""),
        (8, None, 2, "Apache-2.0,MIT"),
    }


def test_rates_meet_the_targets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        p = [rng.random() ** 4 + 1e-3 for _ in range(3)]
        rows.append((i, rng.randint(0, 500), [x / sum(p) for x in p]))
    frame = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    fitted, totals = fit_rates(frame, [9e4, 3e4, 3e4], steps=200)
    assert np.allclose(totals, [9e4, 3e4, 3e4], rtol=1e-4) and fitted.agg(F.min("rate")).first()[0] >= 0
    table = np.array([r[2] for r in rows]) * np.array([[r[1]] for r in rows])
    rates = np.array([r.rate for r in fitted.orderBy("doc_id").collect()])
    assert np.allclose(rates @ table, totals)
    # a target that no nonnegative rates reach: the rates stop at zero instead of going below
    _, low = fit_rates(frame, [0.0, 0.0, 1e5], steps=50)
    assert low[2] > 5 * (low[0] + low[1])


def test_mixing_is_native_and_follows_weights(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mixed = mix_sources(docs, {"en": 1, "de": 3, "xx": 5}).cache()
    assert "Python" not in mixed._jdf.queryExecution().toString() and "Arrow" not in mixed._jdf.queryExecution().toString()
    spent = dict(mixed.groupBy("domain").agg(F.sum(F.col("rate") * F.col("tokens"))).collect())
    assert set(spent) == {"en", "de"} and abs(spent["de"] / spent["en"] - 3) < 0.3
    assert mixed.count() == docs.count()


OPERATORS = {
    "exact": (exact_dedup, brute.exact), "simhash": (simhash_dedup, brute.simhash), "suffix": (suffix_dedup, brute.suffixes), "substring": (substring_dedup, brute.windows),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_and_very_long_texts(spark, frame, rows_of, name):
    prepare(spark)
    operator, plain = OPERATORS[name]
    assert operator(frame([])).collect() == []
    rng = random.Random(9)
    long_text = " ".join(str(rng.randint(0, 999)) for _ in range(60_000))
    rows = [(1, long_text), (2, long_text + " end"), (3, "same " * 5_000), (4, None), (7, "same " * 100)]
    assert rows_of(operator(frame(rows)).drop("kept") if name in ("suffix", "substring") else operator(frame(rows)), *COLUMNS[name]) == plain(rows)


COLUMNS = {
    "exact": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "simhash": ["doc_id", "fingerprint", "component_id"],
    "suffix": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "substring": ["doc_id", "n_words", "n_removed", "kept_sha256"],
}


def test_null_ids_and_repeated_rows(spark, frame, rows_of):
    prepare(spark)
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "d e")]
    docs = frame(rows)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()} == {(None, None, 3, True), (1, None, 3, False), (2, 2, 1, True)}
    assert {(r.doc_id, r.component_id) for r in simhash_dedup(docs).collect()} == {(None, None), (1, None), (2, 2)}
    assert [r.n_hit for r in decontaminate(docs, frame([(None, "b c")], "item_id")).orderBy("doc_id").collect()] == [2, 2, 2, 0]
    assert len(suffix_dedup(docs).collect()) == len(substring_dedup(docs).collect()) == len(mix_sources(docs).collect()) == 4
    assert len(scan_licences(docs, known_licences(spark)).collect()) == 4


def test_other_operators_on_empty_tables(spark, frame):
    prepare(spark)
    none, labels = frame([]), spark.createDataFrame([], "doc_id long, quality int")
    assert mix_sources(none).collect() == scan_licences(none, known_licences(spark)).collect() == quality_scores(none, labels).collect() == []
    assert decontaminate(none, frame([], "item_id")).collect() == []
    assert decontaminate(frame([(1, "a")]), frame([], "item_id")).first().contaminated is False
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(pages).collect() == filter_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).collect() == []


def test_pipeline_against_plain_stages(spark):
    """Every stage's rows follow from the rows before it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before, columns = None, docs.columns
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, docs, DATA).cache()
        rows = sorted((r.doc_id, r.text) for r in after.select("doc_id", "text").collect())
        if name == "exact dedup":
            assert {i for i, _ in rows} == {r[0] for r in brute.exact(before) if r[3]}
        elif name == "simhash near-dedup":
            assert {i for i, _ in rows} == {r[0] for r in brute.simhash(before) if r[0] == r[2]}
        elif name == "benchmark decontamination":
            assert {i for i, _ in rows} == {r[0] for r in brute.contaminated(before, items) if not r[5]}
        elif name == "mixing sources":
            assert rows == before and after.filter("rate <= 0 or tokens < 0").isEmpty()
        assert name == "mixing sources" or after.columns == columns
        before, docs = rows, after
    assert len(corpus_pipeline.STAGES) == 5 and len(rows) == len({hashlib.sha256((t or "").encode()).digest() for _, t in rows})


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
