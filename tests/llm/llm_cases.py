"""Rows with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import duckdb

from clickcast.llm.oracle import ORACLE

SMALL = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"w{k}" for k in range(60))
DOCS = [
    (1, "The quick brown Fox. Jumps over\nthe lazy dog.\n\nThe end", "en", "a", 50),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, " \t\n ", "en", None, 4),
    (None, "no id at all " + PASSAGE, "de", "b", 1),
    (5, "x " * 3000, "en", "c", 6000),
    (5, "x " * 3000, "en", "c", 6000),
    (6, PASSAGE, "fr", "a", 1),
    (7, "before " + PASSAGE + " after", "fr", "a", 1),
    (7, "same id other text " + PASSAGE, None, "a", 1),
    (8, "İstanbul naïve ǅ e\u0301 \U0001f600 日本 語 # $ | <b>", "es", "é", 20),
    (9, " ".join(f"long{k % 977}" for k in range(20000)), "en", "c", 1),
    (10, "The quick brown Fox. Jumps over\nthe lazy dog.\n\nThe end", "en", "a", 50),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row_id", "h", "size", "score", "sig", "node", "key", "block", "word", "spans", "s", "p", "target", "root", "held_out", "tie", "part"]


def docs(spark, rows=None, clash=True):
    out = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)
    if clash:
        for c in CLASHES:
            out = out.selectExpr("*", f"'{c}' as {c}")
    return out


def labels(spark, rows=((1, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (7, None, 0), (7, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def compare(name, df, views):
    """df against the DuckDB SQL of ``name``; ``views``: name -> path or pandas frame."""
    con = duckdb.connect()
    for v, what in views.items():
        if isinstance(what, str):
            con.execute(f"create view {v} as select * from read_parquet('{what}')")
        else:
            con.register(v, what)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    exp = sorted((tuple(r) for r in cur.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got == exp
