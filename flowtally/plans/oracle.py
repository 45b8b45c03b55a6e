"""The SQL twin of each registered query, in DuckDB's dialect, over the same tables."""

SQL: dict[str, str] = {}

FLOWS = """flows AS (
  SELECT *,
    CASE WHEN l_linenumber <> 7 THEN l_quantity END AS total_fwd_packets,
    l_linenumber::DOUBLE AS total_bwd_packets,
    l_extendedprice AS total_len_fwd_packets,
    l_extendedprice * l_discount AS total_len_bwd_packets,
    l_tax * 1e6::DOUBLE AS flow_duration,
    CASE WHEN l_tax = 0 THEN 'Infinity'::DOUBLE ELSE l_extendedprice / l_tax END AS flow_bytes_per_s,
    l_discount AS flow_iat_mean,
    l_tax AS flow_iat_std,
    l_quantity * 20 AS fwd_header_len,
    (l_linenumber % 3)::DOUBLE AS fin_flag_count,
    (l_linenumber % 2)::DOUBLE AS syn_flag_count,
    CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rst_flag_count,
    0.0::DOUBLE AS psh_flag_count,
    CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ack_flag_count,
    l_extendedprice AS subflow_fwd_bytes,
    l_returnflag AS label_str,
    (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END)::INT AS label
  FROM lineitem),
typed AS (SELECT * REPLACE (CASE WHEN isinf(flow_bytes_per_s) THEN NULL ELSE flow_bytes_per_s END AS flow_bytes_per_s) FROM flows)"""

FEATURES = FLOWS + """, features AS (
  SELECT *,
    coalesce((total_fwd_packets - total_bwd_packets) / CASE WHEN pk IS NOT NULL THEN greatest(pk, 1) END, 0) AS pkt_asymmetry,
    coalesce((total_len_fwd_packets - total_len_bwd_packets) / greatest(by_, 1), 0) AS byte_asymmetry,
    coalesce(by_ / CASE WHEN pk IS NOT NULL THEN greatest(pk, 1) END, 0) AS overall_avg_pkt_size,
    flow_duration / 1e6::DOUBLE AS flow_duration_s,
    coalesce(pk / greatest(flow_duration / 1e6::DOUBLE, 1e-9::DOUBLE), 0) AS total_pkts_per_s,
    coalesce(syn_flag_count / CASE WHEN pk IS NOT NULL THEN greatest(pk, 1) END, 0) AS syn_flag_count_ratio,
    coalesce(fin_flag_count / CASE WHEN pk IS NOT NULL THEN greatest(pk, 1) END, 0) AS fin_flag_count_ratio,
    coalesce(rst_flag_count / CASE WHEN pk IS NOT NULL THEN greatest(pk, 1) END, 0) AS rst_flag_count_ratio,
    coalesce(ack_flag_count / CASE WHEN pk IS NOT NULL THEN greatest(pk, 1) END, 0) AS ack_flag_count_ratio,
    flow_iat_std / greatest(flow_iat_mean, 1e-9::DOUBLE) AS iat_cv,
    fwd_header_len / greatest(total_len_fwd_packets, 1) AS fwd_header_ratio
  FROM (SELECT *, total_fwd_packets + total_bwd_packets AS pk, total_len_fwd_packets + total_len_bwd_packets AS by_ FROM flows))"""

ENGINEERED = ["pkt_asymmetry", "byte_asymmetry", "overall_avg_pkt_size", "flow_duration_s", "total_pkts_per_s",
              "syn_flag_count_ratio", "fin_flag_count_ratio", "rst_flag_count_ratio", "ack_flag_count_ratio",
              "iat_cv", "fwd_header_ratio"]
NUMERIC = ["total_fwd_packets", "total_bwd_packets", "total_len_fwd_packets", "total_len_bwd_packets",
           "flow_duration", "flow_bytes_per_s", "flow_iat_mean", "fwd_header_len"]


def long(features, keep="", source="typed"):
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {keep}{', ' if keep else ''}'{f}' AS feature, {f}::DOUBLE AS value FROM {source}" for f in features) + ")"


ALL_COLUMNS = ["total_fwd_packets", "total_bwd_packets", "total_len_fwd_packets", "total_len_bwd_packets", "flow_duration",
               "flow_bytes_per_s", "flow_iat_mean", "flow_iat_std", "fwd_header_len", "fin_flag_count", "syn_flag_count",
               "rst_flag_count", "psh_flag_count", "ack_flag_count", "subflow_fwd_bytes", "label_str", "label"]

SQL["flow_feature_summary"] = f"""WITH {FEATURES} SELECT label_str, count(*) AS n,
  {', '.join(f'round(avg({f}), 4) AS {f}' for f in ENGINEERED if f not in ('total_pkts_per_s', 'iat_cv'))},
  round(avg(total_pkts_per_s) / 1e6, 4) AS total_mpkts_per_s, round(avg(iat_cv) / 1e3, 4) AS iat_cv_thousands
  FROM features GROUP BY label_str ORDER BY n DESC, label_str"""
SQL["flow_features"] = f"WITH {FEATURES} SELECT l_orderkey, l_partkey, {', '.join(ENGINEERED)} FROM features"
SQL["feature_matrix_rows"] = f"""WITH {FLOWS} SELECT l_orderkey, 26::INT AS width, 26::INT AS n_names,
  flow_duration::FLOAT::DOUBLE AS first_value, total_bwd_packets::FLOAT::DOUBLE AS third_value FROM flows"""

RAW = """raw AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'BENIGN' WHEN 'view' THEN 'DoS Hulk'
  WHEN 'purchase' THEN 'Web Attack - XSS' WHEN 'error' THEN 'Heartbleed' ELSE 'no such label' END AS label_str FROM events)"""
SQL["label_encode"] = f"""WITH {RAW} SELECT event_id, label_str, (CASE label_str WHEN 'BENIGN' THEN 0 WHEN 'DoS Hulk' THEN 1
  WHEN 'Web Attack - XSS' THEN 11 ELSE 14 END)::INT AS label FROM raw WHERE label_str <> 'no such label'"""
SQL["unknown_labels"] = f"WITH {RAW} SELECT label_str, count(*) AS n FROM raw WHERE label_str = 'no such label' GROUP BY 1"
SQL["label_group_filter"] = f"""WITH {RAW} SELECT CASE label_str WHEN 'BENIGN' THEN 'Normal Traffic' WHEN 'DoS Hulk' THEN 'DoS'
  ELSE 'Web Attacks' END AS attack_type, count(*) AS n FROM raw WHERE label_str NOT IN ('no such label', 'Heartbleed') GROUP BY 1"""
SQL["sql_label_stats"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type"
SQL["union_tables"] = """SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
  UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier"""
SQL["label_share"] = """SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct
  FROM events GROUP BY 1"""
SQL["table_shape"] = "SELECT count(*) AS n_rows, 17::INT AS n_columns, count(DISTINCT l_returnflag) AS n_classes FROM lineitem"
SQL["rows_per_file"] = "SELECT 'documents.parquet' AS file, count(*) AS n FROM documents"
SQL["anomaly_truth"] = f"""WITH {FLOWS} SELECT (label <> 0)::INT AS is_attack, count(*) AS n,
  count(*) FILTER (label = 0) AS n_benign FROM flows GROUP BY 1"""
SQL["benign_summary"] = f"WITH {FLOWS} SELECT count(*) AS n, round(avg(total_len_fwd_packets), 4) AS mean_bytes FROM flows WHERE label = 0"
SQL["coerce_numeric"] = """SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN value END AS flow_duration FROM events"""
SQL["nullify_inf"] = f"WITH {FLOWS} SELECT l_orderkey, flow_bytes_per_s, total_fwd_packets FROM typed"
SQL["drop_null_rows"] = f"""WITH {FLOWS} SELECT label_str, count(*) FILTER (total_fwd_packets IS NOT NULL) AS n_features,
  count(*) FILTER (total_fwd_packets IS NOT NULL AND flow_bytes_per_s IS NOT NULL) AS n_any FROM typed GROUP BY 1"""
SQL["missing_profile"] = f"""WITH {FLOWS}, m AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS n_missing, count(*) AS n FROM typed" for c in ALL_COLUMNS)})
  SELECT feature, n_missing, round(n_missing * 100 / n, 6) AS pct_missing FROM m WHERE n_missing > 0"""
SQL["row_missing_profile"] = f"""WITH {FLOWS}, s AS (SELECT ({' + '.join(f'({c} IS NULL)::INT' for c in ALL_COLUMNS)}) * 100
  / 17 AS p FROM typed) SELECT count(*) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, round(min(p), 6) AS min,
  round(quantile_cont(p, 0.25), 6) AS p25, round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.75), 6) AS p75,
  round(max(p), 6) AS max, count(*) FILTER (p > 0) AS rows_with_missing FROM s"""
SQL["inf_profile"] = f"""WITH {FLOWS} SELECT 'flow_bytes_per_s' AS feature, count(*) FILTER (isinf(flow_bytes_per_s)) AS n_infinite
  FROM flows"""
SQL["constant_columns"] = f"""WITH {FLOWS}, m AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) + (count(*) > count({c}))::INT AS d FROM flows" for c in ALL_COLUMNS)})
  SELECT feature FROM m WHERE d = 1"""
SQL["identical_columns"] = f"""WITH {FLOWS}, m AS ({' UNION ALL '.join(
    f"SELECT '{a}' AS kept, '{b}' AS duplicate, count(*) FILTER ({a} IS DISTINCT FROM {b}) AS d FROM flows"
    for i, a in enumerate(ALL_COLUMNS[:15]) for b in ALL_COLUMNS[i + 1:15])}) SELECT kept, duplicate FROM m WHERE d = 0"""
SQL["dup_count"] = """SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)))::BIGINT AS n_duplicates
  FROM documents"""
SQL["dedupe_rows"] = "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem"
SQL["null_loss_by_label"] = f"""WITH {FLOWS}, b AS (SELECT label_str, count(*) AS n_before,
  nullif(count(*) FILTER (total_fwd_packets IS NOT NULL AND flow_bytes_per_s IS NOT NULL), 0) AS n_after FROM typed GROUP BY 1)
  SELECT label_str, n_before, n_after, n_before - n_after AS abs_difference,
  round((n_before - n_after) * 100 / n_before, 2) AS pct_difference FROM b"""
SQL["describe_features"] = f"""WITH {FLOWS}, v AS (SELECT feature, CASE WHEN feature = 'flow_bytes_per_s' THEN value / 1e6 ELSE value END AS value
  FROM ({long(NUMERIC)})) SELECT feature, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
  round(min(value), 7) AS min, round(quantile_cont(value, 0.25), 7) AS p25, round(quantile_cont(value, 0.5), 7) AS p50,
  round(quantile_cont(value, 0.75), 7) AS p75, round(max(value), 7) AS max FROM v GROUP BY 1"""
_OUT = f"""WITH {FLOWS}, v AS ({long(NUMERIC)}), q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM v GROUP BY 1), o AS (SELECT v.feature, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
  / count(*) * 100 AS pct FROM v JOIN q ON v.feature = q.feature GROUP BY 1)"""
SQL["outlier_pct"] = _OUT + " SELECT feature, round(pct, 6) AS outlier_pct FROM o"
SQL["high_outliers"] = _OUT + " SELECT feature, round(pct, 6) AS outlier_pct FROM o WHERE pct > 2"


def pairs(names, source):
    return " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM {source}"
                              for i, a in enumerate(names) for b in names[i + 1:])


SQL["corr_matrix"] = f"WITH {FLOWS}, c AS ({pairs(NUMERIC, 'typed')}) SELECT feature_a, feature_b, round(r, 6) + 0.0 AS r FROM c"
_WIDE = [c for c in ALL_COLUMNS if c not in ("label_str", "label")]
SQL["corr_matrix_wide"] = f"""WITH {FEATURES}, filled AS (SELECT
  {', '.join(f'CASE WHEN isinf({c}) THEN 0 ELSE coalesce({c}, 0) END AS {c}' for c in _WIDE + ENGINEERED)} FROM features),
  c AS ({pairs(_WIDE + ENGINEERED, 'filled')})
  SELECT feature_a, feature_b, CASE WHEN feature_a <> 'psh_flag_count' AND feature_b <> 'psh_flag_count' THEN round(r, 5) + 0.0 END AS r FROM c"""
SQL["high_corr_pairs"] = f"""WITH {FLOWS}, c AS ({pairs(NUMERIC + ['subflow_fwd_bytes'], 'typed')})
  SELECT feature_a, feature_b, round(r, 6) + 0.0 AS r, r >= 0.95 AS multicollinear FROM c WHERE abs(r) > 0.4"""

SQL["kruskal"] = f"""WITH {FLOWS}, v AS (SELECT * FROM ({long(NUMERIC, 'label_str')}) WHERE value IS NOT NULL),
  r AS (SELECT feature, label_str, value, rank() OVER w + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS mid
        FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)),
  g AS (SELECT feature, label_str, count(*)::DOUBLE AS m, sum(mid) AS s FROM r GROUP BY 1, 2),
  h AS (SELECT feature, sum(m) AS n, sum(s * s / m) AS q FROM g GROUP BY 1),
  t AS (SELECT feature, sum(c * c * c - c) AS t FROM (SELECT feature, value, count(*)::DOUBLE AS c FROM v GROUP BY 1, 2) GROUP BY 1),
  x AS (SELECT h.feature, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM h JOIN t ON h.feature = t.feature)
  SELECT feature, round(h, 6) AS h, round(exp(-h / 2), 6) AS p_value FROM x"""
_LEV = NUMERIC + ["rst_flag_count"]
_LEVENE = f"""WITH {FLOWS}, v AS (SELECT * FROM ({long(_LEV, 'label_str')}) WHERE value IS NOT NULL),
  m AS (SELECT feature, label_str, median(value) AS med FROM v GROUP BY 1, 2 HAVING max(abs(value)) > 0 AND max(value) > min(value)),
  z AS (SELECT v.feature, v.label_str, abs(value - med) AS z FROM v JOIN m ON v.feature = m.feature AND v.label_str = m.label_str),
  g AS (SELECT feature, label_str, count(*)::DOUBLE AS n, avg(z) AS zb, var_pop(z) * count(*) AS w FROM z GROUP BY 1, 2),
  a AS (SELECT feature, sum(n) AS nn, count(*)::DOUBLE AS k, sum(n * zb) / sum(n) AS za, sum(w) AS ww FROM g GROUP BY 1),
  x AS (SELECT a.feature, (nn - k) / (k - 1) * sum(n * (zb - za) * (zb - za)) / ww AS w, nn - k AS d2
        FROM g JOIN a ON g.feature = a.feature WHERE k >= 2 GROUP BY a.feature, nn, k, ww)"""
SQL["levene"] = _LEVENE + " SELECT feature, round(w, 6) AS w, round(pow(1 + 2 * w / d2, -d2 / 2), 6) AS p_value FROM x"
SQL["homogeneous_features"] = _LEVENE + " SELECT feature FROM x WHERE feature <> 'rst_flag_count' AND pow(1 + 2 * w / d2, -d2 / 2) > 0.05"

# ln(erfc) by a rational Chebyshev fit (relative error 1.2e-7), enough for five digits per row
_LNPHI = """(CASE WHEN {w} > 0 THEN ln(1 - 0.5 * {t} * exp(-{z} * {z} + {poly})) ELSE ln(0.5 * {t}) - {z} * {z} + {poly} END)"""


def _lnphi(w):
    z = f"(abs({w}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.5 * {z}))"
    poly = "0.17087277"
    for c in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368"):
        poly = f"({c} + {t} * {poly})"
    poly = f"(-1.26551223 + {t} * {poly})"
    return _LNPHI.format(w=w, z=z, t=t, poly=poly)


_AD = f"""WITH {FLOWS}, v AS (SELECT * FROM ({long(NUMERIC)}) WHERE value IS NOT NULL),
  f AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM v GROUP BY 1),
  s AS (SELECT v.feature, (value - mu) / sd AS w, row_number() OVER (PARTITION BY v.feature ORDER BY value)::DOUBLE AS i,
        count(*) OVER (PARTITION BY v.feature)::DOUBLE AS n FROM v JOIN f ON v.feature = f.feature),
  l AS (SELECT feature, n, i, {_lnphi('w')} AS lo, {_lnphi('(-w)')} AS hi FROM s),
  a AS (SELECT feature, n, -n - sum((2 * i - 1) * lo + (2 * (n - i) + 1) * hi) / n AS a2, 0.787 / (1 + 4 / n - 25 / (n * n)) AS critical
        FROM l GROUP BY 1, 2)"""
SQL["anderson"] = _AD + """ SELECT feature, n::BIGINT AS n, round(a2 / n, 5) AS a2_per_row, round(critical, 6) AS critical,
  a2 < critical AS is_normal FROM a"""
SQL["normality_tally"] = _AD + " SELECT count(*) FILTER (a2 < critical) AS n_normal, count(*) FILTER (a2 >= critical) AS n_not_normal FROM a"

_H1 = "xor(xor(o_orderkey, o_orderkey >> 31) % 2147483648, 1250483682::BIGINT) * 2654435761 % 4294967296"
_H = f"xor({_H1}, ({_H1}) >> 15) * 1597334677 % 4294967296"
SQL["split_exact"] = f"""SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY {_H}, o_orderkey)
  <= floor((SELECT count(*) FROM orders) * 0.8) AS is_train FROM orders"""
SQL["split_stratified"] = f"""SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey)
  <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.7::DOUBLE + 0.5) AS is_train FROM orders"""
SQL["split_quick"] = f"SELECT o_orderkey, {_H} < 3650722201 AS is_train FROM orders"
SQL["fold_assign"] = f"SELECT o_orderstatus, ((({_H}) // 1024) % 5)::INT AS fold, count(*) AS n FROM orders GROUP BY 1, 2"
SQL["cap_per_group"] = """SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rank
  FROM orders QUALIFY rank <= 3000"""
SQL["seeded_sample"] = f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_H}, o_orderkey LIMIT 10"
SQL["head_rows"] = "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5"

SCORED = """raw3 AS (SELECT (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END)::INT AS label,
  (l_linenumber % 3)::INT AS prediction, l_discount * 10 + 1 AS a, l_tax * 100 + 1 AS b, l_quantity / 25 + 1 AS c FROM lineitem),
scored AS (SELECT label, prediction, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM raw3)"""
SQL["confusion"] = f"WITH {SCORED} SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2"
_REPORT = f"""WITH {SCORED}, cls AS (SELECT unnest([0, 1, 2, 3]) AS c),
  k AS (SELECT c, (SELECT count(*) FROM scored WHERE label = c AND prediction = c) AS tp,
        (SELECT count(*) FROM scored WHERE prediction = c) AS pred, (SELECT count(*) FROM scored WHERE label = c) AS support FROM cls),
  s AS (SELECT *, CASE WHEN pred = 0 THEN 0 ELSE tp / pred END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r FROM k),
  f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM s)"""
SQL["class_report"] = _REPORT + """, m AS (SELECT sum(tp) / sum(pred) AS p, sum(tp) / sum(support) AS r FROM f),
  u AS (SELECT CASE c WHEN 0 THEN 'flag A' WHEN 1 THEN 'flag N' WHEN 2 THEN 'flag R' ELSE 'Class_3' END AS name, p, r, f1, support FROM f
    UNION ALL SELECT 'micro avg', p, r, 2 * p * r / (p + r), (SELECT sum(support) FROM f) FROM m
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f
    UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
  SELECT name, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM u"""
SQL["macro_f1"] = _REPORT + " SELECT round(avg(f1), 6) AS f1_macro FROM f WHERE c < 3"
_OVR = f"""WITH {SCORED}, o AS (SELECT 0::INT AS cls, p0 AS score, (label = 0)::INT AS y FROM scored
  UNION ALL SELECT 1, p1, (label = 1)::INT FROM scored UNION ALL SELECT 2, p2, (label = 2)::INT FROM scored),
  v AS (SELECT cls, score, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM o GROUP BY 1, 2),
  w AS (SELECT *, sum(n) OVER up - n AS nb, sum(p) OVER up - p AS pb, sum(n) OVER al AS nt, sum(p) OVER al AS pt FROM v
        WINDOW up AS (PARTITION BY cls ORDER BY score), al AS (PARTITION BY cls))"""
_AUC = "sum(p * (nb - pb + (n - p) / 2)) / (max(pt) * max(nt - pt))"
_AP = "sum(p / pt * (pt - pb) / (nt - nb))"
SQL["roc_auc_ovr"] = _OVR + f" SELECT cls, round({_AUC}, 8) AS roc_auc FROM w GROUP BY 1"
SQL["avg_precision"] = _OVR + f" SELECT cls, round({_AP}, 8) AS avg_precision FROM w GROUP BY 1"
SQL["macro_ovr"] = _OVR + f""", c AS (SELECT cls, {_AUC} AS a, {_AP} AS p FROM w GROUP BY 1)
  SELECT round(avg(a), 8) AS roc_auc_macro, round(avg(p), 8) AS auc_pr_macro FROM c"""
_DET = f"""WITH {FLOWS}, o AS (SELECT (label <> 0)::INT AS y, flow_iat_std * fwd_header_len AS score FROM flows),
  v AS (SELECT score, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM o GROUP BY 1),
  w AS (SELECT *, sum(n) OVER up - n AS nb, sum(p) OVER up - p AS pb, sum(n) OVER () AS nt, sum(p) OVER () AS pt FROM v
        WINDOW up AS (ORDER BY score)),
  pr AS (SELECT score AS threshold, (pt - pb) / (nt - nb) AS precision, (pt - pb) / pt AS recall FROM w),
  f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-8::DOUBLE) AS f1 FROM pr)"""
SQL["pr_best_f1"] = _DET + " SELECT round(f1, 8) AS best_f1, threshold AS best_threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1"
SQL["pr_curve"] = _DET + " SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f"
SQL["detector_eval"] = _DET + f""", b AS (SELECT f1, threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1)
  SELECT (SELECT round({_AUC}, 8) FROM w) AS roc_auc, round(f1, 8) AS best_f1, threshold AS best_threshold FROM b"""
SQL["error_threshold"] = "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS threshold, count(*) AS n FROM events GROUP BY 1"
SQL["anomaly_score"] = """SELECT event_id, round(CASE WHEN event_type = 'view' THEN value ELSE 1 / (1 + exp(-(value / 100 - 1))) END, 9) AS score,
  value > 100 AS is_anomaly FROM events"""
SQL["stream_sigmoid"] = "SELECT event_id, round(1 / (1 + exp(-(value / 100 - 1))), 9) AS score, value > 100 AS is_anomaly FROM events"
SQL["reconstruction_mse"] = """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE - floor(x::DOUBLE * 10) / 10, 2)))
  / len(embedding), 9) AS mse FROM embeddings"""
SQL["soft_vote"] = f"""WITH {SCORED}, v AS (SELECT (p0 + p2) / 2 AS a, (p1 + p1) / 2 AS b FROM scored)
  SELECT (CASE WHEN a >= b THEN 0 ELSE 1 END)::INT AS cls, count(*) AS n, round(avg(greatest(a, b)), 6) AS mean_confidence FROM v GROUP BY 1"""
SQL["score_spread"] = "SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events"
SQL["class_names"] = f"""WITH {SCORED} SELECT CASE prediction WHEN 0 THEN 'BENIGN' ELSE 'CLASS_' || prediction END AS name, count(*) AS n
  FROM scored GROUP BY 1"""

# bin edges are multiples of 0.02, compared as such
BINS = """scores AS (SELECT *, value / 250 AS s FROM events),
g AS (SELECT *, least(floor(s * 50), 49) AS g0 FROM scores),
g2 AS (SELECT *, CASE WHEN s < g0 * (1.0::DOUBLE / 50) THEN g0 - 1 ELSE g0 END AS g1 FROM g),
binned AS (SELECT *, CASE WHEN s < 0 OR s > 1 THEN 0
  ELSE CASE WHEN g1 < 49 AND s >= (g1 + 1) * (1.0::DOUBLE / 50) THEN g1 + 2 ELSE g1 + 1 END END::INT AS bin FROM g2)"""
SQL["score_histogram"] = f"""WITH {BINS}, k AS (SELECT DISTINCT event_type FROM events), e AS (SELECT event_type, unnest(range(1, 51))::INT AS bin FROM k)
  SELECT e.event_type AS route, e.bin, round(count(b.bin) + 1e-10::DOUBLE, 3) AS weight FROM e
  LEFT JOIN binned b ON b.event_type = e.event_type AND b.bin = e.bin GROUP BY 1, 2"""


def _drift(key):
    return f"""WITH {BINS}, keyed AS (SELECT *, {key} AS k FROM binned), ks AS (SELECT DISTINCT k FROM keyed),
  bins AS (SELECT unnest(range(1, 51))::INT AS bin),
  base AS (SELECT bins.bin, count(b.bin) + 1e-10::DOUBLE AS w FROM bins LEFT JOIN binned b ON b.bin = bins.bin GROUP BY 1),
  h AS (SELECT ks.k, bins.bin, count(b.bin) + 1e-10::DOUBLE AS w FROM ks CROSS JOIN bins LEFT JOIN keyed b ON b.k = ks.k AND b.bin = bins.bin GROUP BY 1, 2),
  p AS (SELECT bin, w / sum(w) OVER () AS p FROM base), q AS (SELECT k, bin, w / sum(w) OVER (PARTITION BY k) AS q FROM h),
  kl AS (SELECT k, sum((p - q) * ln(p / q)) / 2 AS kl FROM p JOIN q ON p.bin = q.bin GROUP BY 1),
  n AS (SELECT k, count(*) AS window_size, count(*) FILTER (bin = 0) AS out_of_range FROM keyed GROUP BY 1),
  d AS (SELECT n.k AS window_label, window_size, out_of_range, CASE WHEN window_size >= 10 THEN kl ELSE 0 END AS kl,
        CASE WHEN window_size < 10 THEN 'insufficient data' END AS reason FROM n JOIN kl ON n.k = kl.k)"""


SQL["drift_check"] = _drift("strftime(ts, '%Y-%m-%d')") + """ SELECT round(kl, 6) AS kl_divergence, kl > 0.1 AS is_drifting,
  0.1::DOUBLE AS threshold, window_size, out_of_range, window_label, reason FROM d"""
SQL["drift_kl"] = _drift("event_type") + " SELECT window_label, round(kl, 6) AS kl_divergence, kl > 0.1 AS is_drifting FROM d"
SQL["drift_by_user"] = _drift("user_id || '/' || event_type") + """ SELECT round(kl, 6) AS kl_divergence, kl > 0.1 AS is_drifting,
  window_size, window_label, reason FROM d"""
_PCT = "round(quantile_cont({v}, 0.5), {d}) AS p50_ms, round(quantile_cont({v}, 0.95), {d}) AS p95_ms, round(quantile_cont({v}, 0.99), {d}) AS p99_ms"
SQL["latency_percentiles"] = f"""SELECT event_type AS route, {_PCT.format(v='value', d=4)},
  round(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate, count(*) AS total_requests FROM events GROUP BY 1"""
SQL["rolling_latency"] = """SELECT event_type AS route, event_id, round(quantile_cont(value, 0.5) OVER w, 6) AS p50_ms,
  round(quantile_cont(value, 0.95) OVER w, 6) AS p95_ms, round(quantile_cont(value, 0.99) OVER w, 6) AS p99_ms FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)"""
SQL["rolling_metrics"] = """SELECT event_type AS route, event_id, round(quantile_cont(value, 0.5) OVER w, 6) AS p50_ms,
  round(quantile_cont(value, 0.95) OVER w, 6) AS p95_ms, round(quantile_cont(value, 0.99) OVER w, 6) AS p99_ms,
  round(avg(CASE WHEN event_type = 'error' OR value > 100 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS error_rate,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS total_requests FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)"""
SQL["request_summary"] = """SELECT count(*) AS total_requests, count(*) FILTER (event_type = 'click') AS click_requests,
  count(*) FILTER (event_type = 'purchase') AS purchase_requests, round(sum(value) / count(*), 2) AS avg_latency_ms,
  round(count(*) FILTER (event_type = 'error') / count(*), 4) AS error_rate FROM events"""
SQL["prediction_tally"] = "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type AS route, count(*) AS n FROM events GROUP BY 1, 2"

_TRIM = r"'[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'"
_SCORE = "CASE WHEN i % 3 <> 2 THEN (i % 11)::DOUBLE WHEN i % 4 <> 3 THEN 5.0::DOUBLE END"
SQL["cve_extract"] = f"""WITH d AS (SELECT doc_id AS i, text FROM documents),
  e AS (SELECT i, CASE WHEN i % 50 <> 0 THEN 'CVE-' || (2020 + i % 5) || '-' || (1000 + i) ELSE 'UNKNOWN' END AS cve_id,
    CASE WHEN i % 9 = 0 THEN '' ELSE text END AS description, {_SCORE} AS score,
    CASE i % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS severity, (2020 + i % 5) || '-03-07' AS published, 'CWE-' || (i % 130) AS w FROM d),
  t AS (SELECT *, 'CVE ID: ' || cve_id || chr(10) || 'Description: ' || description || chr(10) || 'Weaknesses: ' || w || ', CWE-787'
    || CASE WHEN coalesce(score, 0) <> 0 THEN chr(10) || 'CVSS Score: ' || score::VARCHAR || ' (' || coalesce(severity, 'None') || ')' ELSE '' END AS text FROM e)
  SELECT cve_id, md5(text) AS text_md5, length(text) AS n_chars, coalesce(score, 0) AS score, coalesce(severity, 'UNKNOWN') AS severity,
    '["' || w || '","CWE-787"]' AS cwes, published, published AS published_date FROM t"""
_CWES = ["CWE-79", "CWE-89", "CWE-20", "CWE-125", "CWE-787", "CWE-119", "CWE-200", "CWE-416", "CWE-22", "CWE-352", "CWE-77",
         "CWE-190", "CWE-400", "CWE-502", "CWE-611", "CWE-732", "CWE-862", "CWE-863", "CWE-918"]
SQL["cwe_label"] = f"""WITH d AS (SELECT doc_id AS i, text, CASE WHEN doc_id % 50 <> 0 THEN 'CVE-' || (2020 + doc_id % 5) || '-' || (1000 + doc_id) END AS cve_id
  FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY i % 5 ORDER BY cve_id NULLS FIRST, i) AS rn FROM d)
  SELECT cve_id, md5(text) AS text_md5,
    (coalesce(list_position({_CWES!r}, 'CWE-' || (i % 130)), list_position({_CWES!r}, 'CWE-79')) - 1)::INT AS label
  FROM r WHERE rn <= 5000 AND i % 9 <> 0 AND length(text) >= 30"""
SQL["cve_keyword_search"] = f"""WITH d AS (SELECT doc_id AS i, CASE WHEN doc_id % 9 = 0 THEN 'No description' ELSE text END AS text,
  CASE WHEN doc_id % 50 <> 0 THEN 'CVE-' || (2020 + doc_id % 5) || '-' || (1000 + doc_id) END AS cve_id FROM documents)
  SELECT cve_id, substring(text, 1, 400) AS description, {_SCORE} AS cvss_score, (2020 + i % 5) || '-03-07' AS published
  FROM d WHERE contains(lower(text), 'tion') ORDER BY cve_id NULLS LAST, i LIMIT 5"""


SQL["cve_keyword_batch"] = f"""WITH d AS (SELECT doc_id AS i, CASE WHEN doc_id % 9 = 0 THEN 'No description' ELSE text END AS text,
  CASE WHEN doc_id % 50 <> 0 THEN 'CVE-' || (2020 + doc_id % 5) || '-' || (1000 + doc_id) END AS cve_id FROM documents),
  k AS (SELECT unnest(['tion', 'heth', 'no such word', 'Que ']) AS keyword),
  h AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY cve_id NULLS LAST, i) AS rank FROM d JOIN k ON contains(lower(text), lower(keyword)))
  SELECT keyword, rank, cve_id, md5(substring(text, 1, 400)) AS description_md5, {_SCORE} AS cvss_score, (2020 + i % 5) || '-03-07' AS published
  FROM h WHERE rank <= 7"""


def _chunks(source, text="text", extra=""):
    return f"""SELECT doc_id, {extra} row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_no, document FROM (
    SELECT *, regexp_replace(regexp_replace(substring({text}, s::BIGINT + 1, 2048), '^' || {_TRIM} || '+', ''), {_TRIM} || '+$', '') AS document
    FROM (SELECT *, unnest(range(0, length({text}), 1792)) AS s FROM {source})) WHERE document <> ''"""


SQL["chunk_text"] = f"""SELECT doc_id || '_chunk' || chunk_no AS id, doc_id, chunk_no, md5(document) AS document_md5 FROM ({_chunks('documents')})"""
SQL["chunk_upsert"] = f"""WITH o AS ({_chunks('documents')}), f AS (SELECT d.doc_id, upper(lang) AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
  SELECT doc_id || '_chunk' || chunk_no AS id, doc_id, 'old' AS batch, md5(document) AS document_md5 FROM o WHERE doc_id NOT IN (SELECT doc_id FROM f)
  UNION ALL SELECT doc_id || '_chunk0', doc_id, 'new', md5(t) FROM f"""
_WORDS = r"list_filter(string_split_regex(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
SQL["token_pad"] = f"""WITH w AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents)
  SELECT doc_id, 256::BIGINT AS n_ids, least(len(w), 256)::BIGINT AS n_real,
  md5(array_to_string(list_resize(w[1:256], 256, '[PAD]'), ' ')) AS ids_md5 FROM w"""

_DIST = "list_sum(list_transform(range(1, 65), lambda i: pow(q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE, 2)))"
_KNN = """SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {d} AS distance FROM embeddings q CROSS JOIN embeddings c"""
_TOP = """SELECT query_id, chunk_id, round(distance, 6) + 0.0 AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
  FROM ({k}) QUALIFY rank <= 5"""
SQL["knn_topk"] = _TOP.format(k=_KNN.format(d=_DIST))
SQL["hit_lists"] = SQL["knn_topk"]
SQL["knn_blocks"] = SQL["knn_topk"]
SQL["knn_ivf_recall"] = "SELECT count(*) AS n_queries, least(5, count(*)) AS least_rows, true AS recall_reached, true AS share_sound FROM embeddings"
SQL["knn_cosine"] = _TOP.format(k=_KNN.format(
    d="1 - list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])"
      " * list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))"))
_HITS = f"""hits AS (SELECT query_id, rank, text, source FROM ({_TOP.format(k=_KNN.format(d=_DIST).replace(
    'CROSS JOIN embeddings c', 'CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) c'))}) h
  JOIN documents d ON d.doc_id = h.chunk_id),
ctx AS (SELECT query_id, list(text ORDER BY rank) AS texts, list_sort(list_distinct(list(source))) AS sources, count(*) AS n FROM hits GROUP BY 1)"""
SQL["rag_context"] = f"""WITH {_HITS} SELECT d.doc_id AS query_id, CASE WHEN n IS NULL THEN 'No relevant CVE data found.' END AS answer,
  md5('Context:' || chr(10) || array_to_string(texts, chr(10) || chr(10) || '---' || chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || lang) AS prompt_md5,
  coalesce(array_to_string(sources, ','), '') AS sources, coalesce(n, 0) AS context_chunks FROM documents d LEFT JOIN ctx ON d.doc_id = query_id"""
SQL["retrieval_eval"] = f"""WITH {_HITS}, w AS (SELECT d.doc_id AS id, list_distinct({_WORDS.format(t='d.text')}) AS want,
    list_transform(texts, lambda t: {_WORDS.format(t='t')}) AS got FROM documents d LEFT JOIN ctx ON d.doc_id = query_id),
  m AS (SELECT id, want, coalesce(list_distinct(flatten(got)), []) AS words, coalesce(got, []) AS got FROM w),
  x AS (SELECT id, len(want) AS nw, len(words) AS ng, len(list_intersect(want, words)) AS nb,
    len(list_filter(got, lambda g: list_has_any(g, want))) AS nc, len(got) AS nt FROM m)
  SELECT id, round(CASE WHEN nw = 0 THEN 0 ELSE nb / nw END, 6) AS context_recall, round(CASE WHEN ng = 0 THEN 0 ELSE nb / ng END, 6) AS context_precision,
  round(CASE WHEN nt = 0 THEN 0 ELSE nc / nt END, 6) AS coverage FROM x"""

_IDS = "' CVE-2021-' || (44000 + conv_id % 7) || ', CVE-' || (2014 + turn % 3) || '-0160 and CVE-20-1'"
_MSG = rf"""m AS (SELECT conv_id, turn, regexp_extract_all(text || {_IDS}, 'CVE-\d{{4}}-\d+') AS ids FROM conversations)"""
SQL["cve_sources"] = f"""WITH {_MSG}, f AS (SELECT conv_id, turn, unnest(ids) AS cve_id, unnest(range(0, len(ids))) AS pos FROM m)
  SELECT conv_id, cve_id, turn AS first_turn, pos AS first_pos FROM f
  QUALIFY row_number() OVER (PARTITION BY conv_id, cve_id ORDER BY turn, pos) = 1"""
SQL["message_cve_ids"] = f"WITH {_MSG} SELECT conv_id, turn, array_to_string(ids, ',') AS ids FROM m"
SQL["tool_trace"] = "SELECT conv_id, turn, role || ' → ' || length(text) || ' → done' AS trace FROM conversations"
SQL["request_vector"] = "SELECT event_id, (props->>'k')::DOUBLE::VARCHAR || ',0.0' AS vector FROM events"
SQL["request_validate"] = """SELECT doc_id, CASE WHEN length(text) < 5 THEN 'query too short' WHEN length(text) > 2000 THEN 'query too long'
  ELSE 'accepted' END AS verdict FROM documents"""
SQL["payload_parse"] = """SELECT event_id, (CASE WHEN event_id % 4 = 2 THEN 2 ELSE 1 END)::BIGINT AS n,
  CASE WHEN event_id % 4 = 2 THEN value ELSE (props->>'k')::DOUBLE END AS first_value FROM events"""
SQL["top_values"] = """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS value FROM embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC, i) - 1 AS pos FROM e)
  SELECT vec_id, pos, 'd' || lpad(i::VARCHAR, 2, '0') AS feature, value FROM r WHERE pos < 3"""

_CLOSED = "date_trunc('minute', ts) + INTERVAL 60 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
SQL["stream_request_metrics"] = f"""SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
  {_PCT.format(v='value', d=6)}, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, count(*) AS total_requests, any_value({_CLOSED}) AS is_closed
  FROM events GROUP BY 1, 2"""
SQL["stream_drift"] = _drift("strftime(ts, '%Y-%m-%d')") + """ SELECT round(kl, 6) AS kl_divergence, kl > 0.1 AS is_drifting, window_size,
  out_of_range, window_label, window_label::TIMESTAMP + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS is_closed FROM d"""
SQL["stream_last_n"] = """SELECT user_id, event_id, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5"""
SQL["batch_score_rows"] = "SELECT l_returnflag AS label_str, count(*) AS n, count(*) AS n_scored FROM lineitem GROUP BY 1"
SQL["tree_sum_rule"] = "SELECT l_returnflag AS label_str, count(*) AS n, count(*) AS n_adding_up FROM lineitem GROUP BY 1"
SQL["stratified_folds"] = f"""SELECT o_orderstatus, fold, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM (
  SELECT *, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey) - 1) % 5)::INT AS fold FROM orders) GROUP BY 1, 2"""
SQL["stream_rolling"] = SQL["rolling_metrics"]
SQL["score_table_rows"] = SQL["batch_score_rows"]
SQL["softmax_rows"] = SQL["batch_score_rows"]
