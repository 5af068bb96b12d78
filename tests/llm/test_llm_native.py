"""URL filters (1) and mixing (9)."""

import pandas as pd
import pytest
from llm_cases import DOCS, SCHEMA, SMALL, compare, docs

from clickcast.llm import mixing, queries, url_filter

URLS = [
    (1, "https://Www.Example.ORG/es/1?x=1"), (2, "http://example.org/en/12#t"), (3, "http://example.org/en/2"), (4, "http://a.b.com/de/"),
    (5, "http://a.com/fr/x"), (6, None), (7, "no scheme/es/"), (8, "http://org"), (9, "http://"), (None, "http://example.org/es/"),
    (10, "http://example.org/es/"), (10, "http://example.org/es/"), (11, "ftp://xcom/de/"), (12, "http://u:p@example.org:80/es/"),
    (13, "http://e.com/de/" + "a/" * 20000), (14, "http://x.y?//z/de/"), (15, "http://a..com/de/"), (16, "x://y://example.org/es/"),
]


def pages(spark, rows=URLS):
    return spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'q' as host", "'q' as path", "'q' as rule", "1 as labels", "2 as prefix")


def test_url_cases_equal_sql(spark):
    import pandas as pd

    got = url_filter.judge_urls(pages(spark), url_filter.rule_table(spark))
    compare("op1_url_filter", got, {"pages": pd.DataFrame({"page_id": pd.array([p for p, _ in URLS], dtype="Int64"), "url": [u for _, u in URLS]})})


def test_url_rules_precedence_and_edges(spark):
    rules = spark.createDataFrame([("a.org/", "block"), ("a.org/", "allow"), ("org/x/y", "allow"), (None, "block"), ("/p", "block"), ("b.org", "block")],
                                  "rule string, verdict string")
    urls = [(1, "h://a.org/x/y"), (2, "h://c.a.org/z"), (3, "h://b.org"), (4, "h:///p")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages(spark, urls), rules).collect()}
    assert got == {1: ("org/x/y", "allow"), 2: ("a.org/", "block"), 3: ("b.org", "block"), 4: (None, "allow")}
    none = rules.limit(0)
    assert {r.verdict for r in url_filter.judge_urls(pages(spark, urls), none).collect()} == {"allow"}
    assert url_filter.judge_urls(pages(spark, urls).limit(0), rules).count() == 0


@pytest.mark.parametrize("name", ["op1_url_filter", "op6_substring_dedup", "op9_mixing", "op10_quality_rules"])
def test_queries_equal_sql(spark, name):
    compare(name, queries.QUERIES[name](spark, SMALL), {t: f"{SMALL}/{t}.parquet" for t in ("documents", "pages")})


def test_native_plans_have_no_python(spark):
    for df in (url_filter.judge_urls(pages(spark), url_filter.rule_table(spark)), queries.op9_mixing(spark, SMALL)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("MapInPandas", "MapInArrow", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoop"))


def filled(sizes, weights):
    """Water-filling step by step: share, cap at three times, share the excess again."""
    total, left, out = sum(sizes), list(range(len(sizes))), {}
    while left:
        rest = total - sum(out.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in left) for i in left}
        over = [i for i in left if share[i] > 3 * sizes[i]]
        if not over:
            out |= share
            break
        out |= {i: 3 * sizes[i] for i in over}
        left = [i for i in left if i not in over]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1, 1000, 5, 7], [10, 0, 3, 2000, 1, 1, 900], [5]])
def test_targets_are_water_filled(spark, sizes):
    rows = [(f"s{i:02}", n) for i, n in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).orderBy("source").collect()
    assert [r.target for r in got] == pytest.approx(filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_mix_cases(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == len(DOCS)
    assert all(r.taken <= 3 * r.size and (r.size or not r.taken) for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(spark).repartition(3)).collect()), key=str)
    assert mixing.mix(docs(spark, [])).count() == 0
    many = [(i, "w " * (1 + i % 7), "en", "abc"[i % 3] if i % 10 < 4 else "a", 1) for i in range(3000)]
    rows = mixing.mix(spark.createDataFrame(many, SCHEMA)).groupBy("source_size", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 7 for r in rows)


def test_mixed_documents_repeat_whole_rows(spark):
    d = docs(spark)
    taken = mixing.mix(d).groupBy().sum("taken").first()[0]
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    assert out.select(mixing.n_words(out["text"]).alias("n")).groupBy().sum("n").first()[0] == taken


def test_mix_takes_as_many_repeated_rows_as_the_target_allows(spark):
    rows = [(7, "one two three four", "en", "a", 1)] * 40 + [(i, "w " * (1 + i % 5), "en", "b", 1) for i in range(60)]
    rows += [(None, None, "en", "a", 1)] * 3 + [(8, "u v", "en", None, 1)] * 25
    d = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(d)
    for r in got.groupBy("source_size", "target").sum("taken").collect():
        assert abs(r["sum(taken)"] - r.target) <= 4
    frame = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "text": [r[1] for r in rows], "source": [r[3] for r in rows]})
    compare("op9_mixing", got, {"documents": frame})
    out = mixing.mixed_documents(d)
    assert out.filter("text is not null").select(mixing.n_words(out["text"]).alias("n")).groupBy().sum("n").first()[0] == got.groupBy().sum("taken").first()[0]
    assert out.filter("text is null").count() == 3


def test_mixed_documents_with_own_names_of_columns(spark):
    d = docs(spark, clash=False)
    for c in ("row_id", "size", "hash", "copy", "threshold", "whole", "take_equal", "__size", "__h", "t", "d"):
        d = d.selectExpr("*", f"'{c}' as {c}")
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns and all(r.threshold == "threshold" and r.row_id == "row_id" for r in out.collect())
