"""Branches of the template tree that are small against their host, many, or deep."""

from __future__ import annotations

from embedmap.llm import urltree


def judged(spark, urls):
    """(url, unwanted or None) to {url: (verdict, template)}."""
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(urls) if bad is not None], "id long, unwanted int")
    return {r.url: (r.verdict, r.template) for r in urltree.judge_urls(pages, labels).collect()}


def test_an_unwanted_directory_of_few_urls_is_blocked(spark):
    """Four of a hundred urls of the host, in one directory of many."""
    urls = [(f"http://h.test/d{i % 48}/page-{i}", 0) for i in range(960)] + [(f"http://h.test/spam/page-{i}", 1) for i in range(40)]
    got = judged(spark, urls)
    assert {got[u][0] for u, bad in urls if bad} == {"block"} and {got[u][0] for u, bad in urls if not bad} == {"allow"}
    assert got["http://h.test/spam/page-1"][1] == "/spam/*"


def test_many_equally_common_sections_stay_apart(spark):
    urls = [(f"http://h.test/s{i % 30}/page-{i}", int(i % 30 >= 20)) for i in range(600)]
    got = judged(spark, urls)
    assert all(got[u][0] == ("block" if bad else "allow") for u, bad in urls)
    assert len({t for _, t in got.values()}) == 2


def test_branches_at_the_seventh_level_and_below(spark):
    for top in ("a/b/c/d/e/f", "a/b/c/d/e/f/g/h/i"):
        urls = [(f"http://h.test/{top}/{'bad' if i % 4 == 0 else 'good'}/page-{i}", int(i % 4 == 0)) for i in range(120)]
        got = judged(spark, urls)
        assert all(got[u] == (("block", f"/{top}/bad/*") if bad else ("allow", f"/{top}/good/*")) for u, bad in urls)


def test_single_labels_are_not_sorted_by_outcome(spark):
    """A third of directories has one unwanted label each by chance: none is rejected."""
    urls = [(f"http://h.test/d{i // 6}/page-{i}", (int(i // 6 % 3 == 0) if i % 6 == 0 else None)) for i in range(360)]
    assert {v for v, _ in judged(spark, urls).values()} == {"allow"}
