"""The URL filter's labelled table and model against plain logistic regression."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import url_filter as uf

RATE, DECAY, STEPS = uf.RATE, uf.DECAY, uf.STEPS


def rows_of(spark, urls):
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i long, url string")
    host, path = uf.url_parts(F.col("url"))
    return [r.f for r in table.select("i", uf.features(host, path).alias("f")).orderBy("i").collect()]


def plain_fit(rows, labels):
    """Gradient descent on the weights themselves, from zero, with weight decay."""
    x = np.zeros((len(rows), uf.BUCKETS))
    for i, f in enumerate(rows):
        x[i, f] = 1 / math.sqrt(len(f))
    w = np.zeros(uf.BUCKETS)
    for _ in range(STEPS):
        w = w * (1 - DECAY) + RATE * x.T @ (labels - 1 / (1 + np.exp(-x @ w)))
    return w


@pytest.fixture(scope="module")
def weights(spark):
    return uf.fit(spark)


def test_the_model_is_a_logistic_regression(spark, weights):
    urls, labels = zip(*uf.labelled_urls())
    assert np.allclose(weights, plain_fit(rows_of(spark, urls), np.array(labels, float)), atol=1e-6)


def test_verdicts_are_the_regressions(spark, sf_dir, weights):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    got = uf.filter_urls(pages, weights=weights).collect()
    assert len(got) == len(urls)
    for r, f in zip(got, rows_of(spark, [urls[r.page_id] for r in got])):
        logit = sum(weights[b] for b in f) / math.sqrt(len(f))
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)
        if r.rule is None:
            assert r.verdict == ("block" if logit >= 0 else "allow")


def test_held_out_urls(spark, weights):
    held = uf.labelled_urls("held_out")
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    blocked = {r.page_id for r in uf.filter_urls(table, (), weights).collect() if r.verdict == "block"}
    bad = {i for i, (_, y) in enumerate(held) if y}
    precision, recall = len(blocked & bad) / len(blocked), len(blocked & bad) / len(bad)
    print(f"precision {precision:.2f}, recall {recall:.2f} of {len(held)} held-out URLs")
    assert precision >= 0.7 and recall >= 0.6  # 0.75 and 0.66 when the table was made


def test_no_host_is_in_both_parts_or_in_the_tables(spark):
    name = lambda u: u.split("://")[1].split("/")[0].removeprefix("www.").removeprefix("blog.").removeprefix("m.").removeprefix("shop.").removeprefix("en.").split(".")[0]
    train, held = ({name(u) for u, _ in uf.labelled_urls(p)} for p in ("train", "held_out"))
    assert not train & held and len(train) == 80 and len(held) == 40
    host, _ = uf.url_parts(F.col("url"))
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
        labels = {x for r in pages.select(host.alias("h")).distinct().collect() for x in r.h.split(".")}
        assert not (train | held) & labels
