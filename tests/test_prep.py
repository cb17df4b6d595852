from pyspark.sql import functions as F

from flowloom.config import NOT_ATTACK_TYPES
from flowloom.operators import prep

LABELS = ("DDoS", "DoS Hulk", " backdoor ", "0", "1", "Benign", "", "\tportscan\n", None)


def labelled(spark):
    """Rows whose label is made by cases, as views on raw tables make it."""
    out = F.when(F.col("id") % 9 == 0, LABELS[0])
    for i, name in enumerate(LABELS[1:], 1):
        out = out.when(F.col("id") % 9 == i, F.lit(name).cast("string"))
    side = F.when(F.col("id") % 10 < 2, "BENIGN").when(F.col("id") % 10 < 8, "MALICIOUS")
    return spark.range(180).select("id", side.alias("binary_label"), out.alias("attack_type"))


def test_attack_filter_does_not_copy_the_expression_of_the_label(spark):
    found = prep.attacks_only(labelled(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("dos hulk") == 1


def test_attack_filter_keeps_the_right_rows_and_columns(spark):
    df = labelled(spark)
    found = prep.attacks_only(df)
    assert found.columns == df.columns
    want = []
    for r in df.collect():
        kind = r["attack_type"] and r["attack_type"].upper().strip(" \t\n\r\x0b\x0c")
        if r["binary_label"] == "MALICIOUS" and kind is not None and kind not in NOT_ATTACK_TYPES:
            want.append((r["id"], "MALICIOUS", kind))
    assert want and sorted(map(tuple, found.collect())) == want
