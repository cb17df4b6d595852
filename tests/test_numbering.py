from pyspark.sql import functions as F

from flowloom.operators.history import with_history
from flowloom.operators.numbering import dense_index, numbered


def test_late_burst_gives_equal_slices(spark):
    """The order values of one key: a few spread out, then a burst."""
    rows = spark.range(4000).selectExpr("'hot' AS k", "IF(id < 9, id * 1000000000, 9000000000 + id) AS seq", "CAST(id AS INT) AS v")
    cut = with_history(rows, ["k"], "seq", 5, 500, keep=["v"]).filter("NOT _carried")
    sizes = [r["n"] for r in cut.groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.5 * min(sizes)


def test_numbers_are_those_of_a_window(spark):
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'b' ELSE 'k' || id END AS k", "IF(id % 7 = 0, NULL, id * 37 % 3001) AS o", "id")
    got = numbered(rows, ["k"], ["o", "id"], "i", 100).collect()
    want: dict = {}
    for r in sorted(got, key=lambda r: (r.o is not None, r.o or 0, r.id)):
        want[r.k] = want.get(r.k, 0) + 1
        assert r.i == want[r.k], r
    assert len(got) == 3000


def test_repeated_rows_and_no_rows(spark):
    rows = spark.range(500).selectExpr("1 AS k", "5 AS o")
    assert sorted(r.i for r in dense_index(rows, ["k"], ["o"], "i").collect()) == list(range(1, 501))
    assert dense_index(rows.limit(0), ["k"], ["o"], "i").count() == 0
    assert numbered(rows.limit(0), ["k"], ["o"], "i", 10).columns == ["k", "o", "i"]
