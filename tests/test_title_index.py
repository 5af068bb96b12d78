import pytest
from clickcast.operators import title_index as TI
from clickcast.sources.tables import shop_products
from conftest import SF_SMALL

TITLES = ["Red Lamp", "a red red red lamp", "aaaa", "aaa", "", None, "Straße İstanbul", "été d'Été", "50% off", "under_score", "ab", "b", "日本語の本", "red", "dre dred"]
TERMS = ["red", "RED", "aa", "aaa", "aaaa", "a", "b", "red l", "d r", "straSSe", "İst", "ist", "ÉTÉ", "本", "日本", "日本語", "no such title", "zz", "%", "5_%", "under_", ""]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([(10 * i, t) for i, t in enumerate(TITLES)], "id long, title string")


@pytest.fixture(scope="module")
def postings(spark, products, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "postings")
    TI.write_title_index(products, path)
    return TI.read_title_index(spark, path)


@pytest.mark.parametrize("term", TERMS)
def test_the_index_finds_what_the_scan_finds(spark, products, postings, term):
    from pyspark.sql import functions as F
    want = sorted(r.id for r in products.filter(F.col("title").ilike(f"%{term}%")).collect())
    got = TI.indexed_search(postings, products, term, limit=100).collect()
    assert sorted(r.id for r in got) == want and {r.total for r in got} <= {len(want)}
    if TI.indexable(term):
        assert sorted(r.id for r in TI.title_hits(postings, term).collect()) == want


def test_pages_by_key(products, postings):
    seen, after = [], None
    while rows := sorted(TI.indexed_search(postings, products, "r", after, limit=2).collect(), key=lambda r: r.id):
        assert len(rows) <= 2 and {r.total for r in rows} == {6}
        seen += [r.id for r in rows]
        after = seen[-1]
    assert seen == sorted({r.id for r in TI.title_hits(postings, "r").collect()}) and len(seen) == 6


def test_hits_read_the_postings_of_the_term_alone(spark, tmp_path):
    path = str(tmp_path / "postings")
    TI.write_title_index(shop_products(spark, SF_SMALL), path)
    plan = TI.title_hits(TI.read_title_index(spark, path), "lemon")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "p_name" not in plan
    assert "PushedFilters: [In(gram, [emo,lem,mon])]" in plan


def test_an_empty_catalogue(spark, tmp_path):
    none = spark.createDataFrame([], "id long, title string")
    TI.write_title_index(none, f"{tmp_path}/p")
    assert TI.indexed_search(TI.read_title_index(spark, f"{tmp_path}/p"), none, "red").count() == 0
