"""Column names, label tables and record schemas of the flow and advisory data."""

from __future__ import annotations

from pyspark.sql import types as T

# The raw flow CSV headers in file order and the column name of each.
RAW_HEADERS: list[tuple[str, str]] = [
    (" Destination Port", "destination_port"),
    (" Flow Duration", "flow_duration"),
    (" Total Fwd Packets", "total_fwd_packets"),
    (" Total Backward Packets", "total_bwd_packets"),
    ("Total Length of Fwd Packets", "total_len_fwd_packets"),
    (" Total Length of Bwd Packets", "total_len_bwd_packets"),
    (" Fwd Packet Length Max", "fwd_pkt_len_max"),
    (" Fwd Packet Length Min", "fwd_pkt_len_min"),
    (" Fwd Packet Length Mean", "fwd_pkt_len_mean"),
    (" Fwd Packet Length Std", "fwd_pkt_len_std"),
    ("Bwd Packet Length Max", "bwd_pkt_len_max"),
    (" Bwd Packet Length Min", "bwd_pkt_len_min"),
    (" Bwd Packet Length Mean", "bwd_pkt_len_mean"),
    (" Bwd Packet Length Std", "bwd_pkt_len_std"),
    ("Flow Bytes/s", "flow_bytes_per_s"),
    (" Flow Packets/s", "flow_pkts_per_s"),
    (" Flow IAT Mean", "flow_iat_mean"),
    (" Flow IAT Std", "flow_iat_std"),
    (" Flow IAT Max", "flow_iat_max"),
    (" Flow IAT Min", "flow_iat_min"),
    ("Fwd IAT Total", "fwd_iat_total"),
    (" Fwd IAT Mean", "fwd_iat_mean"),
    (" Fwd IAT Std", "fwd_iat_std"),
    (" Fwd IAT Max", "fwd_iat_max"),
    (" Fwd IAT Min", "fwd_iat_min"),
    ("Bwd IAT Total", "bwd_iat_total"),
    (" Bwd IAT Mean", "bwd_iat_mean"),
    (" Bwd IAT Std", "bwd_iat_std"),
    (" Bwd IAT Max", "bwd_iat_max"),
    (" Bwd IAT Min", "bwd_iat_min"),
    ("Fwd PSH Flags", "fwd_psh_flags"),
    (" Bwd PSH Flags", "bwd_psh_flags"),
    (" Fwd URG Flags", "fwd_urg_flags"),
    (" Bwd URG Flags", "bwd_urg_flags"),
    (" Fwd Header Length", "fwd_header_len"),
    (" Bwd Header Length", "bwd_header_len"),
    ("Fwd Packets/s", "fwd_pkts_per_s"),
    (" Bwd Packets/s", "bwd_pkts_per_s"),
    (" Min Packet Length", "min_pkt_len"),
    (" Max Packet Length", "max_pkt_len"),
    (" Packet Length Mean", "pkt_len_mean"),
    (" Packet Length Std", "pkt_len_std"),
    (" Packet Length Variance", "pkt_len_variance"),
    ("FIN Flag Count", "fin_flag_count"),
    (" SYN Flag Count", "syn_flag_count"),
    (" RST Flag Count", "rst_flag_count"),
    (" PSH Flag Count", "psh_flag_count"),
    (" ACK Flag Count", "ack_flag_count"),
    (" URG Flag Count", "urg_flag_count"),
    (" CWE Flag Count", "cwe_flag_count"),
    (" ECE Flag Count", "ece_flag_count"),
    (" Down/Up Ratio", "down_up_ratio"),
    (" Average Packet Size", "avg_pkt_size"),
    (" Avg Fwd Segment Size", "avg_fwd_segment_size"),
    (" Avg Bwd Segment Size", "avg_bwd_segment_size"),
    (" Fwd Header Length.1", "fwd_header_len2"),
    ("Fwd Avg Bytes/Bulk", "fwd_avg_bytes_bulk"),
    (" Fwd Avg Packets/Bulk", "fwd_avg_pkts_bulk"),
    (" Fwd Avg Bulk Rate", "fwd_avg_bulk_rate"),
    (" Bwd Avg Bytes/Bulk", "bwd_avg_bytes_bulk"),
    (" Bwd Avg Packets/Bulk", "bwd_avg_pkts_bulk"),
    ("Bwd Avg Bulk Rate", "bwd_avg_bulk_rate"),
    ("Subflow Fwd Packets", "subflow_fwd_pkts"),
    (" Subflow Fwd Bytes", "subflow_fwd_bytes"),
    (" Subflow Bwd Packets", "subflow_bwd_pkts"),
    (" Subflow Bwd Bytes", "subflow_bwd_bytes"),
    ("Init_Win_bytes_forward", "init_win_bytes_fwd"),
    (" Init_Win_bytes_backward", "init_win_bytes_bwd"),
    (" act_data_pkt_fwd", "act_data_pkt_fwd"),
    (" min_seg_size_forward", "min_seg_size_fwd"),
    ("Active Mean", "active_mean"),
    (" Active Std", "active_std"),
    (" Active Max", "active_max"),
    (" Active Min", "active_min"),
    ("Idle Mean", "idle_mean"),
    (" Idle Std", "idle_std"),
    (" Idle Max", "idle_max"),
    (" Idle Min", "idle_min"),
    (" Label", "label"),
]

RENAMES: dict[str, str] = dict(RAW_HEADERS)
FEATURES: list[str] = [name for _, name in RAW_HEADERS if name != "label"]

# Label ids. The dash of the web attack labels is normalised to "-" first.
LABEL_IDS: dict[str, int] = {
    "BENIGN": 0,
    "DoS Hulk": 1,
    "PortScan": 2,
    "DDoS": 3,
    "DoS GoldenEye": 4,
    "FTP-Patator": 5,
    "SSH-Patator": 6,
    "DoS slowloris": 7,
    "DoS Slowhttptest": 8,
    "Bot": 9,
    "Web Attack - Brute Force": 10,
    "Web Attack - XSS": 11,
    "Web Attack - Sql Injection": 12,
    "Infiltration": 13,
    "Heartbleed": 14,
}

# Display name of each label id.
LABEL_NAMES: dict[int, str] = {
    0: "BENIGN",
    1: "DoS Hulk",
    2: "PortScan",
    3: "DDoS",
    4: "DoS GoldenEye",
    5: "FTP-Patator",
    6: "SSH-Patator",
    7: "DoS slowloris",
    8: "DoS Slowhttptest",
    9: "Bot",
    10: "Web Attack - Brute Force",
    11: "Web Attack - XSS",
    12: "Web Attack - SQL Injection",
    13: "Infiltration",
    14: "Heartbleed",
}

# The coarse group of each label.
LABEL_GROUPS: dict[str, str] = {
    "BENIGN": "Normal Traffic",
    "DoS Hulk": "DoS",
    "DDoS": "DDoS",
    "PortScan": "Port Scanning",
    "DoS GoldenEye": "DoS",
    "FTP-Patator": "Brute Force",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "SSH-Patator": "Brute Force",
    "Bot": "Bots",
    "Web Attack - Brute Force": "Web Attacks",
    "Web Attack - XSS": "Web Attacks",
    "Infiltration": "Infiltration",
    "Web Attack - Sql Injection": "Web Attacks",
    "Heartbleed": "Miscellaneous",
}
RARE_GROUPS: list[str] = ["Infiltration", "Miscellaneous"]

# Columns dropped after the correlation and the importance review.
COLLINEAR_COLUMNS: list[str] = [
    "total_bwd_packets", "total_len_bwd_packets", "subflow_bwd_bytes",
    "avg_fwd_segment_size", "avg_bwd_segment_size",
]
IRRELEVANT_COLUMNS: list[str] = [
    "ece_flag_count", "rst_flag_count", "fwd_urg_flags", "idle_std",
    "fwd_psh_flags", "active_std", "down_up_ratio", "urg_flag_count",
]

# Derived flow features in model order.
ENGINEERED: list[str] = [
    "pkt_asymmetry", "byte_asymmetry", "overall_avg_pkt_size", "flow_duration_s",
    "total_pkts_per_s", "syn_flag_count_ratio", "fin_flag_count_ratio",
    "rst_flag_count_ratio", "ack_flag_count_ratio", "iat_cv", "fwd_header_ratio",
]

# Weakness labels of the text classifier, id = position.
CWE_LABELS: list[str] = [
    "CWE-79", "CWE-89", "CWE-20", "CWE-125", "CWE-787", "CWE-119", "CWE-200",
    "CWE-416", "CWE-22", "CWE-352", "CWE-77", "CWE-190", "CWE-400", "CWE-502",
    "CWE-611", "CWE-732", "CWE-862", "CWE-863", "CWE-918", "OTHER",
]

# The reader parses numbers itself; text in a number column becomes null.
RAW_FLOW_SCHEMA = T.StructType([
    T.StructField(name, T.StringType() if name == "label" else T.DoubleType()) for _, name in RAW_HEADERS])

_METRIC = "ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE, baseSeverity: STRING>>>"
VULNERABILITY_DDL = (
    "cve STRUCT<id: STRING,"
    " descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>,"
    f" metrics: STRUCT<cvssMetricV31: {_METRIC}, cvssMetricV30: {_METRIC}, cvssMetricV2: {_METRIC}>,"
    " weaknesses: ARRAY<STRUCT<description: ARRAY<STRUCT<lang: STRING, value: STRING>>>>,"
    " published: STRING>"
)
VULNERABILITY_PAGE_DDL = f"totalResults BIGINT, vulnerabilities ARRAY<STRUCT<{VULNERABILITY_DDL.replace('cve STRUCT', 'cve: STRUCT', 1)}>>"
ADVISORY_DDL = (
    "ARRAY<STRUCT<cve_id: STRING, title: STRING, description: STRING, mitigation: STRING,"
    " cwes: ARRAY<STRING>, cvss_score: DOUBLE, severity: STRING, attack_type: STRING>>"
)
