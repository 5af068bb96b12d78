from collections import Counter

import numpy as np
import pandas as pd
import pytest

from clickcast.operators import recommend as RC
from clickcast.plans import inputs as I
from conftest import SF_SMALL


def _brute(requests, peers):
    out = Counter()
    for req, seeds in requests:
        for own in peers:
            if set(seeds) & set(own):
                out.update({(req, p): n for p, n in own.items()})
    return dict(out)


@pytest.mark.parametrize("n_products", [6, 5000])
def test_tiles_equal_brute_force(monkeypatch, n_products):
    """Few products (full matrix) and many (looked up), in chunks smaller than the tile."""
    monkeypatch.setattr(RC, "CHUNK", 7)
    monkeypatch.setattr(RC, "HELD_ROWS", 50)
    rng = np.random.default_rng(n_products)
    ids = rng.permutation(10 * n_products)[:n_products]
    pick = lambda: rng.choice(ids, min(5, n_products // 2), replace=False)
    requests = [(int(100 + i), pick()) for i in range(20)]
    peers = [{int(p): int(rng.integers(1, 9)) for p in pick()} for _ in range(60)] + [{int(ids[0]): 1 << 40}, {int(p): 3 for p in requests[0][1]}]
    got = RC.tile_counts(pd.DataFrame(requests, columns=["req", "pids"]),
                         pd.DataFrame({"pids": [np.array(list(p)) for p in peers], "n": [np.array(list(p.values())) for p in peers]}))
    assert dict(zip(zip(got.req, got.pid), got.n)) == _brute(requests, peers)


def test_no_row_per_pair_of_request_and_peer(spark, monkeypatch):
    ue = I.user_events(spark, SF_SMALL)
    req = ue.selectExpr("customer_key as actor", "id_type").distinct()
    whole = RC.co_occurrence(ue, req)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "peer_type" not in plan.split("FlatMapCoGroupsInPandas")[0]
    monkeypatch.setattr(RC, "REQUESTS_PER_TILE", 5)
    monkeypatch.setattr(RC, "ROWS_PER_TILE", 60)
    tiled = RC.co_occurrence(ue, req)
    assert sorted(whole.collect()) == sorted(tiled.collect()) and whole.count() > 50
    assert RC.co_occurrence(ue, req.limit(0)).count() == 0
