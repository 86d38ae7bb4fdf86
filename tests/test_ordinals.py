from pagelore.functions.ordinals import ordinal


def test_ordinal_equals_a_window(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE id % 3 END AS k", "id * 13 % 1009 AS o")
    got = ordinal(df, "k", "o", "n", bucket=50)
    want = df.selectExpr("k", "o", "row_number() OVER (PARTITION BY k ORDER BY o) AS n")
    assert sorted(map(tuple, got.select("k", "o", "n").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
