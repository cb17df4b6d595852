import pytest
from pyspark.sql import functions as F

from flowloom.config import Config, MODEL_FEATURES
from flowloom.operators import datasets as ds, prep, scoring, training
from flowloom.plans.detect import decide_packets
from flowloom.sources import models
from tests.test_chain import frame, packets

SMALL = training.TreeSettings(rounds=4, depth=3, rate=0.3, subsample=1.0, column_share=1.0, bins=16)
SANITY = (443, 6, 2.5, 15, 8500, 40, 1460, 566, 480, 6.0, 0.17, 1, 1, 0, 1, 64, 566, 6.0, 566, 3400, 0.85, 3)


@pytest.fixture(scope="module")
def flows(spark):
    """Benign flows near the sanity row; attacks far from it, in three kinds."""
    base = spark.range(600).withColumn("kind", F.col("id") % 4)
    columns = []
    for i, name in enumerate(MODEL_FEATURES):
        jitter = (F.hash("id", F.lit(i)) % 100) / 1000.0
        columns.append((F.lit(float(SANITY[i])) * (1 + jitter) + F.col("kind") * (i + 1) * 10).cast("float").alias(name))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("BENIGN", "DDoS", "Recon", "Botnet")]), (F.col("kind") + 1).cast("int"))
    df = base.select(*columns, kinds.alias("attack_type"))
    df = df.withColumn("binary_label", F.when(F.col("attack_type") == "BENIGN", "BENIGN").otherwise("MALICIOUS"))
    return df.persist()


def test_train_save_load_score(spark, flows, folder):
    binary = training.train_binary(flows, settings=SMALL, top_k=6)
    attack = training.train_attack(flows.filter("binary_label = 'MALICIOUS'"), settings=SMALL, top_k=5)
    assert binary.classes == ["BENIGN", "MALICIOUS"] and len(binary.selected) == 6
    assert attack.classes == ["Botnet", "DDoS", "Recon"]
    right = attack.predict(flows.filter("attack_type = 'Recon'")).filter("predicted = 2").count()
    assert right > 140
    models.save_models(spark, models.ModelBundle(binary, attack), folder)
    bundle = models.load_models(spark, folder)
    assert bundle.kind == "two_stage" and bundle.binary.classes == binary.classes
    test = flows.limit(50)
    a = binary.probabilities(test).select("prob").collect()
    b = bundle.binary.probabilities(test).select("prob").collect()
    assert a == b

    # the sanity row comes in seconds, models see what scaling makes of it
    one = spark.createDataFrame([tuple(float(v) for v in SANITY)], ", ".join(f"{c} double" for c in MODEL_FEATURES))
    raw = binary.probabilities(one.select(*[F.col(c).cast("float").alias(c) for c in MODEL_FEATURES])).first().prob
    assert raw[0] > raw[1]
    scored = scoring.score(one, bundle).first()
    assert scored.det_prediction in ("Benign", "Suspicious", *attack.classes)
    single = scoring.score(one, models.ModelBundle(attack)).first()
    assert single.det_attack_label in attack.classes and 0 <= single.det_confidence <= 100

    # through the chain: only due packets are scored, none is lost
    cfg = Config(min_flow_packets=4, min_flow_duration=0.5, classify_interval=2)
    rows = packets(5, 150)
    out = decide_packets(frame(spark, rows), cfg, scorer=scoring.ModelScorer(bundle, cfg)).collect()
    assert len(out) == len(rows)
    skipped = {"ip_fragment_skipped", "trusted_port_bypass", "flow_warmup", "flow_interval_skip"}
    assert all((r.ml_confidence is None) == (r.reason in skipped) for r in out)
    assert any(r.ml_confidence is not None for r in out)


def test_stage_two_runs_on_the_rest_only(spark, flows):
    class Fixed:
        classes = ["BENIGN", "MALICIOUS"]
        def probabilities(self, df, out):
            bad = F.when(F.col("ttl") > 65, F.lit(0.9)).otherwise(F.lit(0.1))
            return df.withColumn(out, F.array(1 - bad, bad))
    class Attack:
        classes = ["A", "B"]
        def probabilities(self, df, out):
            return df.withColumn(out, F.array(F.lit(0.95), F.lit(0.05)))
    out = scoring.score_two_stage(flows, Fixed(), Attack())
    counts = {r.det_prediction: r["count"] for r in out.groupBy("det_prediction").count().collect()}
    assert set(counts) == {"Benign", "A"} and sum(counts.values()) == 600


def test_calibration(spark, flows):
    fit = lambda rows: training.train_multiclass(rows, "attack_type", training.TreeSettings(
        rounds=2, depth=2, rate=0.3, subsample=1.0, column_share=1.0, bins=8))
    model = training.calibrate(flows.drop("binary_label"), "attack_type", fit, folds=2)
    assert len(model.calibrators) == 4
    rows = model.probabilities(flows).select("prob").collect()
    assert all(abs(sum(r.prob) - 1) < 1e-9 for r in rows)
    cm = training.confusion(model.predict(flows).withColumn("truth", scoring.decode_label(
        F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("attack_type")) - 1, None).cast("double")),
        "truth", "predicted")
    report = {r.label: r for r in training.classification_report(cm).collect()}
    assert report["accuracy"].f1 > 0.5 and report["accuracy"].support == 600


def test_informative_features_win(spark, flows):
    noisy = flows.withColumn("ttl", F.rand(1).cast("float"))
    chosen = training.mutual_info_top_k(noisy, ["ttl", "dst_port", "byte_rate"], "binary_label", 2)
    assert chosen == ["dst_port", "byte_rate"]


def test_draw_is_exact_with_copies(spark, folder):
    """A third of a class is one and the same row."""
    rows = [("a", 7)] * 400 + [("a", i) for i in range(800)] + [("b", i) for i in range(30)] + [(None, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    for bits in (0, 4, 16):
        out = prep.draw(df, "k", F.least(F.col("count"), F.lit(100)), 42, bits)
        got = {(r.k, r.drawn): r["count"] for r in out.groupBy("k", "drawn").count().collect()}
        assert got == {("a", True): 100, ("a", False): 1100, ("b", True): 30, (None, True): 50}
    again = [prep.cap_classes(df, "k", 20).orderBy("k", "v").collect() for _ in range(2)]
    assert again[0] == again[1]
    train, test = prep.stratified_split(df, "k")
    assert test.count() == 240 + 6 + 10 and train.count() == 1280 - 256
    assert sorted(map(str, train.union(test).collect())) == sorted(map(str, df.collect()))


def test_clean_bounds_and_labels(spark):
    inf, nan = float("inf"), float("nan")
    cases = [(1.0, "x"), (inf, "x"), (-inf, "x"), (nan, "x"), (None, "x"), (1e15, "x"), (2.0, None), (-9e14, "y")]
    df = spark.createDataFrame(cases, "v double, s string")
    assert prep.clean(df).count() == 2
    assert prep.clean(df, bound=None).count() == 3
    p = prep.profile(df).first()
    assert (p.missing, p.infinite, p.row_count, p.column_count) == (3, 2, 8, 2)
    labels = spark.createDataFrame([("BENIGN",), (" benign",), ("Normal",), (None,), ("0",)], "label string")
    got = [r[0] for r in labels.select(ds.binary_label("label")).collect()]
    assert got == ["BENIGN", "MALICIOUS", "BENIGN", "MALICIOUS", "MALICIOUS"]


def test_groups_take_the_first_hit(spark):
    cases = [("DDOS", "DDoS"), ("DOS HULK", "DoS"), ("FTP-PATATOR", "BruteForce"), ("WEB ATTACK BRUTE FORCE", "BruteForce"),
             ("MIRAI-BOT", "Botnet"), ("MIRAI", "IoT"), ("RECON-MITM", "Recon"), ("EXPLOITS", "Other")]
    df = spark.createDataFrame(cases, "attack_type string, want string")
    assert all(r.attack_type == r.want for r in prep.group_attacks(df).collect())


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], [" Label ", "Flow IAT"])
    assert ds.normalise_columns(df).columns == ["label", "flow iat"]
    with pytest.raises(ValueError, match="clash"):
        ds.normalise_columns(spark.createDataFrame([(1, 2)], ["A ", "a"]))


def test_probabilities_are_those_of_mllib(spark, flows):
    """One function for all trees gives what the members and curves give one by one."""
    from pyspark.ml.functions import vector_to_array
    attacks = flows.filter("binary_label = 'MALICIOUS'")
    plain = training.train_attack(attacks, settings=SMALL, top_k=None)
    curved = training.calibrate(attacks, "attack_type", lambda part: training.train_attack(part, settings=SMALL), folds=2)
    gap = spark.createDataFrame([(None,) * len(MODEL_FEATURES)], ", ".join(f"{c} float" for c in MODEL_FEATURES))
    given = attacks.select(*MODEL_FEATURES).union(gap)
    for model in (plain, curved):
        rows = model._vector(given)
        for i, member in enumerate(model.members):
            rows = member.transform(rows).withColumn(f"p{i}", vector_to_array(member.getProbabilityCol())[1])
        for i, curve in enumerate(model.calibrators):
            rows = curve.transform(rows.withColumn(curve.getFeaturesCol(), F.col(f"p{i}"))).withColumn(f"p{i}", F.col(curve.getPredictionCol()))
        total = sum((F.col(f"p{i}") for i in range(3)), F.lit(0.0))
        want = F.array(*[F.when(total > 0, F.col(f"p{i}") / total).otherwise(1 / 3) for i in range(3)])
        both = model.probabilities(rows.withColumn("want", want)).select("prob", "want").collect()
        assert len(both) == 451 and all(abs(a - b) < 1e-12 for r in both for a, b in zip(r.prob, r.want))
    text = model.probabilities(given)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("score(") <= 2 and "UDF(" not in text.replace("PythonUDF(", "")


def test_trees_are_fitted_on_bounded_partitions(spark, flows):
    wide = flows.coalesce(1)
    assert training.in_parts(wide, 100).rdd.getNumPartitions() == 6
    assert max(training.in_parts(wide, 100).rdd.glom().map(len).collect()) <= 110
    assert training.in_parts(wide).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("name", ["balanced_weights", "indexed_labels"])
def test_flows_are_mapped_once(spark, name):
    """What reads the classes again does not read the flows again."""
    from workload.queries import QUERIES
    read = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not any("lineitem" in f for f in read)
