import math

import pytest
from pyspark.sql import functions as F

from flowtally.functions.flow_features import add_flow_features, feature_matrix
from flowtally.functions.numeric import at_least, sigmoid_score
from flowtally.operators import clean
from flowtally.schema import ENGINEERED, FEATURES, LABEL_IDS, RAW_HEADERS

ONE_WAY = ("total_fwd_packets double, total_bwd_packets double, total_len_fwd_packets double, total_len_bwd_packets double,"
           " flow_duration double, syn_flag_count double, flow_iat_mean double, flow_iat_std double, fwd_header_len double, note string")


def test_schema_sizes():
    assert len(RAW_HEADERS) == 79 and len(FEATURES) == 78 and len(ENGINEERED) == 11 and len(LABEL_IDS) == 15


def test_one_way_flow(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 20.0, None)], ONE_WAY)
    r = add_flow_features(df).first()
    assert (r.pkt_asymmetry, r.byte_asymmetry, r.overall_avg_pkt_size, r.flow_duration_s) == (1.0, 0.0, 0.0, 0.0)
    assert r.total_pkts_per_s == pytest.approx(1e9)
    assert (r.syn_flag_count_ratio, r.iat_cv, r.fwd_header_ratio) == (1.0, 0.0, 20.0)
    assert "fin_flag_count_ratio" not in r.asDict() and r.note is None


def test_null_count_gives_zero(spark):
    df = spark.createDataFrame([(None, 3.0, 10.0, 2.0, 1e6, 1.0, 1.0, 1.0, 20.0, "x")], ONE_WAY)
    r = add_flow_features(df).first()
    assert (r.total_fwd_packets, r.pkt_asymmetry, r.overall_avg_pkt_size, r.total_pkts_per_s, r.syn_flag_count_ratio) == (0, 0, 0, 0, 0)
    assert r.byte_asymmetry == pytest.approx(8 / 12)


def test_matrix_order(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.1, 0.0, 0.0, 1.0, 0.0, 0.0, 20.0, None)], ONE_WAY)
    m, names = feature_matrix(df)
    assert names[0] == "flow_duration" and names[-1] == "fwd_header_ratio" and len(m.first().features) == len(names)
    assert m.first().features[names.index("total_len_fwd_packets")] == pytest.approx(0.1, abs=1e-8)
    assert m.first().features[names.index("total_len_fwd_packets")] != 0.1


def test_clip_keeps_null(spark):
    row = spark.createDataFrame([(None, 0.5)], "a double, b double").select(at_least(F.col("a"), 1), at_least(F.col("b"), 1)).first()
    assert tuple(row) == (None, 1.0)


def test_sigmoid(spark):
    df = spark.createDataFrame([(2.0,)], "e double")
    e = F.col("e")
    row = df.select(sigmoid_score(e, 2.0), sigmoid_score(e, None), sigmoid_score(e, 0.0), sigmoid_score(e, 1.0)).first()
    assert tuple(row)[:3] == (0.5, 2.0, 2.0) and row[3] == pytest.approx(1 / (1 + math.exp(-1)))


def raw(spark, rows):
    return spark.createDataFrame(rows, " Flow Duration string, Label string, extra string".replace(" Flow", "` Flow").replace("Duration", "Duration`"))


def test_clean_flows(spark):
    rows = [("12", " BENIGN ", "a"), ("Infinity", "BENIGN", "b"), ("abc", "BENIGN", "c"), ("NaN", "BENIGN", "d"), ("", "BENIGN", "e"),
            ("3.5", "Web Attack \x96 XSS", "f"), ("4", "Web Attack � XSS", "g"), ("5", "Web Attack – XSS", "h"), ("6", "odd", "i"), ("7", None, "j")]
    got = {r.extra: r for r in clean.clean_flows(raw(spark, rows)).collect()}
    assert set(got) == {"a", "f", "g", "h"}
    assert got["a"].flow_duration == 12.0 and got["a"].label_str == "BENIGN" and got["a"].label == 0
    assert {got[k].label for k in "fgh"} == {11}
    audit = clean.unknown_label_audit(clean.rename_flow_columns(raw(spark, rows))).collect()
    assert {(r.label_str, r.n) for r in audit} == {("odd", 1), (None, 1)}


def test_groups_types_and_columns(spark):
    df = spark.createDataFrame([("BENIGN", 1, 0.5), ("Heartbleed", 2, 0.1), ("DoS Hulk", 3, 0.2)], "label_str string, n int, x double")
    grouped = clean.drop_rare_groups(clean.group_labels(df))
    assert {r.attack_type for r in grouped.collect()} == {"Normal Traffic", "DoS"}
    assert clean.feature_types(grouped, "attack_type") == (["n", "x"], ["label_str"])
    assert clean.strip_headers(df.toDF(" a", "b ", "c")).columns == ["a", "b", "c"]
    assert clean.drop_columns(df, ["n", "absent"]).columns == ["label_str", "x"]


def test_duplicates_treat_nan_and_null_alike(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (float("nan"), None), (float("nan"), None), (None, "a")], "x double, s string")
    assert clean.drop_duplicate_rows(df).count() == 3
