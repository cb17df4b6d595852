"""Settings of the detection chain, and the fixed values results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values -----------------------------------------------------------
# Port sets, label sets, keyword lists, messages and column orders that must
# be exactly these for the results to be right.

ENCRYPTED_PORTS = (443, 465, 563, 853, 993, 995, 8443)
TRUSTED_PORTS = (12743, 6881, 6882, 6883, 6884, 6885, 6886, 6887, 6888, 6889, 51413)

BENIGN_LABELS = ("benign", "normal")
AMBIGUOUS_LABELS = ("other", "unknown", "suspicious", "none")
BLOCK_KEYWORDS = ("ddos", "dos", "brute", "bruteforce", "brute force")
RECON_KEYWORDS = ("recon", "reconnaissance", "scan", "portscan", "port scan")
CRITICAL_KEYWORDS = ("ddos", "dos", "botnet", "infiltration", "ransomware")
HIGH_KEYWORDS = ("brute", "exploit", "web attack", "sql", "xss", "portscan", "scan")

WARMUP_REASONS = ("flow_warmup", "flow_interval_skip", "ip_fragment_skipped", "trusted_port_bypass")

# reason -> (severity, signature, rule id), where the reason alone decides
REASON_VERDICTS = {
    "model_low_confidence": ("info", "ML monitoring: low confidence", "ML-MONITOR"),
    "model_uncertain_attack": ("low", "ML warning: uncertain attack class", "ML-WARN"),
    "flow_warmup": ("info", "Flow warmup: collecting evidence", "FLOW-WARMUP"),
    "flow_interval_skip": ("info", "Flow warmup: collecting evidence", "FLOW-WARMUP"),
    "ip_fragment_skipped": ("info", "Flow warmup: collecting evidence", "FLOW-WARMUP"),
    "trusted_port_bypass": ("info", "Flow warmup: collecting evidence", "FLOW-WARMUP"),
    "high_packet_rate": ("critical", "Sustained packet-rate anomaly", "META-1001"),
    "encrypted_metadata_only": ("info", "Encrypted service metadata", "META-1002"),
}
BASELINE_VERDICT = ("info", "Metadata baseline", "META-0000")

NOTE_BLOCKLISTED = "Matched existing blocklist rule"
NOTE_UNCERTAIN = "ML warning: uncertain class, review before treating as attack"
NOTE_REVIEW = "ML warning: review before treating as attack"
NOTE_MANUAL_BLOCK = "Manual block from IDS log"

LEGACY_FLOW_ID = "LEGACY"
LEGACY_RULE_ID = "LEGACY-0000"

SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}

# (rule id or prefix pattern, name, category)
DETECTION_SOURCES = (
    ("ML-*", "ML model classification", "model"),
    ("META-1001", "Sustained packet-rate anomaly", "metadata"),
    ("META-1002", "Encrypted service metadata", "metadata"),
    ("META-0000", "Metadata baseline", "baseline"),
    ("RESPONSE", "Manual blocklist response", "response"),
)

# class -> substrings of the upper-case label; the first class that hits wins
ATTACK_GROUPS = (
    ("DDoS", ("DDOS",)),
    ("DoS", ("DOS",)),
    ("Recon", ("SCAN", "RECON")),
    ("BruteForce", ("PATATOR", "BRUTE")),
    ("WebAttack", ("XSS", "SQL", "INJECTION")),
    ("Botnet", ("BOT",)),
    ("IoT", ("MIRAI", "IOT")),
    ("MITM", ("MITM",)),
    ("Malware", ("BACKDOOR", "MALWARE")),
)
ATTACK_GROUP_REST = "Other"
NOT_ATTACK_TYPES = ("0", "1", "BENIGN", "")

FLOW_FEATURES = (
    "dst_port", "protocol", "flow_duration", "total_packets", "total_bytes",
    "min_pkt_len", "max_pkt_len", "avg_pkt_len", "pkt_len_std", "flow_rate",
    "iat", "syn_flag", "ack_flag", "rst_flag", "psh_flag", "ttl",
)
MODEL_FEATURES = FLOW_FEATURES + (
    "bytes_per_packet", "packets_per_second", "avg_packet_size",
    "byte_rate", "burstiness", "flag_sum",
)

LOG_COLUMNS = (
    "id", "timestamp", "source_ip", "destination_ip", "source_port", "destination_port",
    "protocol", "flow_id", "flow_packet_count", "flow_byte_count", "flow_duration",
    "length", "time_diff", "packet_rate", "avg_length", "encrypted_likely",
    "prediction", "ml_confidence", "binary_label", "attack_label", "severity",
    "signature", "rule_id", "action", "reason", "response_note",
)
# --- End of fixed values ----------------------------------------------------

EPS = 1e-6
WHITESPACE = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Config:
    """Every threshold of the chain. Frozen, so one value serves a whole job."""

    rolling_window: int = 50          # packets in the rolling features
    high_packet_rate: float = 1000.0  # packets/s that count as an anomaly without a model
    min_flow_packets: int = 12        # a flow is scored from this many packets ...
    min_flow_duration: float = 3.0    # ... and this many seconds on
    classify_interval: int = 5        # then on every n-th packet only
    skip_portless: bool = True
    stage1_threshold: float = 65.0    # detector: malicious-class confidence
    stage2_threshold: float = 85.0    # detector: attack-class confidence
    binary_threshold: float = 65.0    # gate after the detector
    alert_threshold: float = 85.0     # severity: below is info
    medium_ceiling: float = 90.0      # severity: below is medium
    vote_window: int = 5
    vote_ratio: float = 0.6
    recon_limit: int = 3
    # Largest window group one task should sort. Sessions above it are cut into
    # slices of this many sequence numbers, with exact carry-over between them.
    slice_rows: int = 2_000_000


DEFAULT = Config()
