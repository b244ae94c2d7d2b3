"""Registered searches on indexes trained on the whole table, against brute force in numpy."""

from __future__ import annotations

import numpy as np
import pytest

from embedmap.operators import ann
from embedmap.plans import vector_queries as vq
from embedmap.plans.all import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def truth(spark):
    """Nearest rows of every fiftieth row."""
    rows = vq.base(spark, SF).orderBy("row_id").collect()
    ids, x = np.array([r.row_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    asked = ids % 50 == 0
    best = np.argsort(-np.round(x[asked] @ x.T, 6), axis=1, kind="stable")[:, : vq.K]
    return {int(q): set(ids[b].tolist()) for q, b in zip(ids[asked], best)}


def recall(hits, truth):
    found = {q: set() for q in truth}
    for r in hits.collect():
        found[r.q].add(r.row_id)
    return sum(len(found[q] & t) / vq.K for q, t in truth.items()) / len(truth)


@pytest.mark.parametrize("search,report,train", [("ivf_search_trained", "ivf_search_recall_trained", "ivf_train"),
                                                 ("ivf_codes_search", "ivf_codes_recall", "train_codes"),
                                                 ("pq_search_trained", "pq_search_refined_trained", "pq_train")])
def test_trained_searches_find_nine_of_ten(spark, truth, monkeypatch, search, report, train):
    """Training sees every row, and recall is at least 0.9."""
    seen, real = [], getattr(ann, train)
    monkeypatch.setattr(ann, train, lambda base, *a, **b: seen.append(base.count()) or real(base, *a, **b))
    got = recall(QUERIES[search](spark, SF), truth)
    said = {r.asDict().get("stage", "refined"): r for r in QUERIES[report](spark, SF).collect()}["refined"]
    print(search, got, said)
    assert got >= 0.9 and said.recall >= 0.9 and said.n_queries == len(truth)
    assert seen == [vq.base(spark, SF).count()] * 2


def test_report_has_recall_and_measured_times(spark):
    got = {(r.setting, r.grp): r for r in QUERIES["evaluation_report_trained"](spark, SF).collect()}
    print(got)
    assert set(got) == {(s, g) for s in (vq.TRAINED_NPROBE, vq.TRAINED_LISTS) for g in (0, 1)}
    for (setting, _), r in got.items():
        assert r.n_queries == 20 and r.recall_24 >= (1.0 if setting == vq.TRAINED_LISTS else 0.9)
        assert 0 < r.p50_ms <= r.p95_ms and r.p50_ms != int(r.p50_ms)


def test_report_of_seeded_lists_keeps_its_percentiles(spark):
    q = np.array([r[0] for r in vq.probe_queries(spark, SF).select("q").collect()])
    got = {(r.setting, r.grp): r for r in QUERIES["evaluation_report"](spark, SF).collect()}
    assert set(got) == {(s, g) for s in (vq.NPROBE, vq.LISTS) for g in (0, 1)}
    for (setting, grp), r in got.items():
        ms = (q[q // 50 % 2 == grp] * 7 % 13 + setting).astype(float)
        assert r.p50_ms == np.percentile(ms, 50) and r.p95_ms == pytest.approx(np.percentile(ms, 95))
