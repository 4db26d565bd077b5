"""Names that several operators share: the flow features and the layout of a capture record."""

from __future__ import annotations

# The 20 features of a scanned window, in vector order.
FEATURES = [
    "flow_duration", "header_length", "protocol_type", "duration", "rate", "srate", "syn_flag_number",
    "ack_flag_number", "rst_count", "http", "tcp", "udp", "icmp", "tot_sum", "pkt_min", "pkt_max", "pkt_avg",
    "pkt_std", "tot_size", "variance",
]

# The 14 fields of a capture record, in file order, and the nine of them that are features.
RECORD_FIELDS = [
    "row_no", "captured_at", "device", "flow_duration", "Header_Length", "Protocol Type", "Rate", "Srate",
    "Tot sum", "Min", "AVG", "Max", "label", "note",
]
RECORD_FEATURES = RECORD_FIELDS[3:12]
