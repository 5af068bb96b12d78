from clickcast.llm import kneser_ney


def test_the_model_is_fitted_to_every_trusted_row(spark):
    """More trusted rows of one language than the former limit of 50,000."""
    rows = spark.range(60_000).selectExpr("id as row_id", "id as doc_id", "cast(id as string) as text", "'en' as lang")
    ids = spark.range(60_000).selectExpr("id as doc_id", "id % 5 = 0 as held_out")
    more = rows.selectExpr("row_id + 60000 as row_id", "doc_id", "text", "lang")  # ids may repeat
    got = kneser_ney.training_rows(rows.unionByName(more), ids)
    assert got.count() == 96_000 and got.filter("text % 5 = 0").count() == 0
