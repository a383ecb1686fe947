"""Fixed values that carry meaning; results depend on them being exactly these."""

from __future__ import annotations

# Ports of local discovery chatter.
OS_NOISE_PORTS = [137, 138, 139, 1900, 3702, 5353, 5355]

# Ports that make a packet "well_known".
WELL_KNOWN_PORTS = [
    22, 53, 80, 110, 143, 443, 993, 995, 1433, 1723, 3306, 3389, 5060, 5432,
    5900, 6379, 8080, 8443, 27017,
]

EPHEMERAL_FLOOR = 49152

# Port -> display name. A different set from WELL_KNOWN_PORTS.
PORT_SERVICES = {
    20: "FTP-DATA",
    21: "FTP",
    22: "SSH",
    23: "TELNET",
    25: "SMTP",
    53: "DNS",
    67: "DHCP",
    68: "DHCP",
    80: "HTTP",
    110: "POP3",
    123: "NTP",
    143: "IMAP",
    443: "HTTPS",
    445: "SMB",
    993: "IMAPS",
    995: "POP3S",
    1433: "MSSQL",
    1723: "PPTP",
    3306: "MySQL",
    3389: "RDP",
    5060: "SIP",
    5353: "mDNS",
    5432: "Postgres",
    5900: "VNC",
    6379: "Redis",
    8080: "HTTP-ALT",
    8443: "HTTPS-ALT",
    27017: "MongoDB",
}

# Rows kept by the live views.
TOP_N = 10
PORT_TOP_N = 30
RECENT_PACKETS = 60

# Trailing windows: label -> minutes.
WINDOW_MINUTES = {"5m": 5, "10m": 10, "30m": 30, "60m": 60}

# Retention.
BRONZE_RETENTION_HOURS = 72
SILVER_RETENTION_DAYS = 7
GOLD_RETENTION_DAYS = 30

# Files below these sizes count as small.
PARQUET_SMALL_BYTES = 1024 * 1024
NDJSON_SMALL_BYTES = 10 * 1024 * 1024

# Drop-rate thresholds in percent.
HEALTH_GREEN_MAX = 0.5
HEALTH_YELLOW_MAX = 2.0

# Metrics.
LATENCY_STAGES = ["capture_to_queue", "queue_to_bronze", "bronze_to_silver", "silver_to_gold"]
LATENCY_SAMPLES = 1000
RATE_WINDOW_SECONDS = 10
RECENT_ERRORS = 10
SNAPSHOT_HEALTHY_SECONDS = 10

# Masks of the shareable views.
MASKED_IP = "x.x.x.xxx"
MASKED_PORT = "****"
MASKED_SUBNET = "x.x.x.0/24"

# IP protocol numbers with a name.
IP_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}

# TCP flag bits in output order.
TCP_FLAGS = [
    (0x01, "F"),
    (0x02, "S"),
    (0x04, "R"),
    (0x08, "P"),
    (0x10, "A"),
    (0x20, "U"),
    (0x40, "E"),
    (0x80, "C"),
]

# Ports on which a payload is looked at.
HTTP_PORTS = [80, 8000, 8001, 8080]
SMTP_PORTS = [25, 465, 587]
HTTP_REQUEST_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH"]

# DNS question types with a name (IANA registry, common ones).
DNS_TYPES = {
    1: "A",
    2: "NS",
    5: "CNAME",
    6: "SOA",
    12: "PTR",
    15: "MX",
    16: "TXT",
    28: "AAAA",
    33: "SRV",
    35: "NAPTR",
    43: "DS",
    46: "RRSIG",
    48: "DNSKEY",
    64: "SVCB",
    65: "HTTPS",
    255: "ANY",
    257: "CAA",
}
