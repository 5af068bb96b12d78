from clickcast.operators import recommend as RC
from clickcast.operators import rules as RU
from clickcast.plans import inputs as I
from clickcast.plans.registry import session_mining_baskets
from clickcast.sources.tables import shop_products
from conftest import SF_SMALL


def test_recommendations_properties(spark):
    ue = I.user_events(spark, SF_SMALL)
    fi = RU.frequent_itemsets(session_mining_baskets(spark, SF_SMALL))
    recs = RC.recommend_for_all(ue, shop_products(spark, SF_SMALL), RU.association_rules(fi), fi).toPandas()
    seeds = RC.recent_interactions(ue).toPandas()
    seen = set(zip(seeds.actor, seeds.id_type, seeds.product_id))
    assert not any((a, t, p) in seen for a, t, p in zip(recs.actor, recs.id_type, recs.product_id))
    g = recs.groupby(["actor", "id_type"])
    assert (g.size() == 8).all()
    assert (g.product_id.nunique() == 8).all()
    assert (g["rank"].apply(lambda r: sorted(r) == list(range(1, 9)))).all()
    # stages appear in cascade order within an actor
    for _, grp in g:
        st = grp.sort_values("rank").stage.tolist()
        assert st == sorted(st)
    assert seeds.groupby(["actor", "id_type"]).size().max() <= 10


def test_co_occurrence_for_requests_brute_force(spark):
    from collections import Counter
    ue = I.user_events(spark, SF_SMALL)
    seeds = RC.recent_interactions(ue).toPandas()
    reqs = sorted(set(zip(seeds.actor, seeds.id_type)))[:5]
    req_df = spark.createDataFrame(reqs, "actor string, id_type string")
    got = RC.co_occurrence(ue, req_df).toPandas()
    ev = ue.select("customer_key", "id_type", "product_id").toPandas()
    for a, t in reqs:
        s = set(seeds[(seeds.actor == a) & (seeds.id_type == t)].product_id)
        peers = set(zip(ev[ev.product_id.isin(s)].customer_key, ev[ev.product_id.isin(s)].id_type))
        cnt = Counter(p for k, ty, p in zip(ev.customer_key, ev.id_type, ev.product_id)
                      if (k, ty) in peers and p not in s)
        exp = sorted(cnt.items(), key=lambda x: (-x[1], x[0]))[:8]
        g = got[(got.actor == a) & (got.id_type == t)].sort_values("pos")
        assert list(zip(g.product_id, g.co_count)) == exp
