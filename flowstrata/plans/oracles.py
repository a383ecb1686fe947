"""The same questions in SQL over the same Parquet tables, for checking."""

from __future__ import annotations

from .. import constants as C
from .inputs import AS_OF, PACKET_SQL

_TEXT_TS = "strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"
_DENSE_TS = "(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id * 5))"
_AS_OF = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'"
_ISO = (
    r"\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)?)?"
)


def _packets(dense: bool = False) -> str:
    ts = _TEXT_TS.format(ts=_DENSE_TS if dense else "ts")
    columns = ",\n".join(part.strip() for part in PACKET_SQL.format(ts=ts).split(";"))
    return f"packets AS (SELECT event_id AS seq, {columns} FROM events)"


def _ports(ports) -> str:
    return "(" + ", ".join(str(p) for p in ports) + ")"


def _either(test: str) -> str:
    return f"coalesce(src_port {test}, FALSE) OR coalesce(dst_port {test}, FALSE)"


def _silver_from(source: str, date: str = "CAST(wall AS DATE)", hour: str = "date_trunc('hour', wall) - to_minutes(off_min)") -> str:
    return f"""
readable AS (SELECT *, substr(timestamp, 12) AS tp FROM {source} WHERE regexp_full_match(timestamp, '{_ISO}')),
signed AS (SELECT *, greatest(instr(tp, '+'), instr(tp, '-')) AS sgn, instr(tp, 'Z') AS zed FROM readable),
clocked AS (SELECT *,
  TRY_CAST(substr(timestamp, 1, 10) || ' ' || CASE WHEN sgn > 0 THEN substr(tp, 1, sgn - 1)
    WHEN zed > 0 THEN substr(tp, 1, zed - 1) ELSE tp END AS TIMESTAMP) AS wall,
  CASE WHEN sgn > 0 THEN (CASE WHEN substr(tp, sgn, 1) = '-' THEN -1 ELSE 1 END)
    * (CAST(substr(tp, sgn + 1, 2) AS INT) * 60 + CAST(substr(tp, sgn + 4, 2) AS INT)) ELSE 0 END AS off_min
  FROM signed),
silver AS (SELECT seq, wall - to_minutes(off_min) AS event_ts, {hour} AS event_hour, {date} AS event_date,
  src_ip, dst_ip, src_port, dst_port, upper(protocol) AS protocol, length, ttl, flags, service_info,
  CASE WHEN src_port IS NULL AND dst_port IS NULL THEN 'unknown'
       WHEN {_either(f"IN {_ports(C.OS_NOISE_PORTS)}")} THEN 'os_noise'
       WHEN {_either(f"IN {_ports(C.WELL_KNOWN_PORTS)}")} THEN 'well_known'
       WHEN {_either(f">= {C.EPHEMERAL_FLOOR}")} THEN 'ephemeral' ELSE 'user_app' END AS port_category,
  agent_id,
  CASE WHEN len(string_split(src_ip, '.')) = 4 THEN array_to_string(string_split(src_ip, '.')[1:3], '.') || '.0/24'
       ELSE src_ip END AS src_network
  FROM clocked WHERE wall IS NOT NULL)"""


_VALID = "valid AS (SELECT * FROM packets WHERE length >= 0)"
SILVER = f"WITH {_packets()}, {_VALID}, {_silver_from('valid')}"
DENSE = f"WITH {_packets(True)}, {_VALID}, {_silver_from('valid')}"

_SILVER_COLUMNS = (
    "event_ts, event_hour, event_date, src_ip, dst_ip, src_port, dst_port, protocol, length, ttl, flags,"
    " service_info, port_category, agent_id, src_network"
)
_ADDITIVE = """event_hour, event_date, protocol, src_network, agent_id, count(*) AS packet_count,
 CAST(sum(length) AS BIGINT) AS total_bytes, CAST(sum(length) AS DOUBLE) / count(*) AS avg_packet_size,
 min(event_ts) AS first_seen, max(event_ts) AS last_seen"""
_GOLD = f"""SELECT {_ADDITIVE}, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
 count(DISTINCT dst_port) AS unique_dst_ports FROM silver GROUP BY ALL"""
_SUMS = "count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes"
_PCT = "packets * CAST(100 AS DOUBLE) / (SELECT count(*) FROM silver) AS pct"
_BY_PROTOCOL = f"""gold AS ({_GOLD}), by_protocol AS (SELECT protocol, CAST(sum(packet_count) AS BIGINT) AS packets,
 CAST(sum(total_bytes) AS BIGINT) AS bytes, max(unique_src_ips) AS src, max(unique_dst_ips) AS dst,
 max(unique_dst_ports) AS ports FROM gold GROUP BY protocol)"""


def _human(column: str) -> str:
    steps, limit = [], 1
    for unit in ("B", "KiB", "MiB", "GiB"):
        value = f"CAST({column} AS DOUBLE) / {limit}"
        limit *= 1024
        steps.append(f"WHEN abs({column}) < {limit} THEN format('{{:.1f}} {unit}', {value})")
    return f"CASE {' '.join(steps)} ELSE format('{{:.1f}} TiB', CAST({column} AS DOUBLE) / {limit}) END"


def _top(keys: str, limit: int, where: str = "TRUE", measures: str = "count(*) AS packets") -> str:
    return f"SELECT {keys}, {measures} FROM silver WHERE {where} GROUP BY {keys} ORDER BY packets DESC, {keys} LIMIT {limit}"


def _share(inner: str, extra: str = "") -> str:
    return f"{SILVER} SELECT *, {_PCT}{extra} FROM ({inner})"


def _port_view(where: str) -> str:
    names = " ".join(f"WHEN {port} THEN '{name}'" for port, name in C.PORT_SERVICES.items())
    return _share(
        _top("dst_port, protocol", 30, f"dst_port IS NOT NULL AND {where}", _SUMS),
        f", CASE dst_port {names} ELSE '' END AS service, {_human('bytes')} AS size",
    )


_BREAKDOWNS = """
SELECT 'protocols' AS breakdown, protocol AS name, NULL AS dst_port, NULL AS protocol, length FROM silver
UNION ALL SELECT 'top_src_ips', src_ip, NULL, NULL, length FROM silver
UNION ALL SELECT 'top_dst_ips', dst_ip, NULL, NULL, length FROM silver
UNION ALL SELECT 'top_subnets', src_network, NULL, NULL, length FROM silver
UNION ALL SELECT 'top_dst_ports', CAST(dst_port AS VARCHAR), dst_port, NULL, length FROM silver WHERE dst_port IS NOT NULL
UNION ALL SELECT 'port_stats', CAST(dst_port AS VARCHAR), dst_port, protocol, length FROM silver WHERE dst_port IS NOT NULL
UNION ALL SELECT 'services', service_info, NULL, NULL, length FROM silver WHERE service_info <> ''"""
_RANKED_BREAKDOWNS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY breakdown
   ORDER BY packets DESC, dst_port NULLS FIRST, name NULLS FIRST, protocol NULLS FIRST) AS rank
 FROM (SELECT breakdown, name, dst_port, protocol, {_SUMS} FROM ({_BREAKDOWNS}) GROUP BY ALL)),
breakdowns AS (SELECT breakdown, rank, name, protocol, packets, bytes FROM ranked
  WHERE rank <= CASE WHEN breakdown = 'port_stats' THEN 30 ELSE 10 END)"""

_DIMENSIONS = {"protocol": "protocol", "subnet": "src_network", "service": "service_info"}


def _buckets() -> str:
    return " UNION ALL ".join(
        f"SELECT date_trunc('minute', event_ts) AS minute, '{label}' AS dimension, {column} AS name, {_SUMS} FROM silver"
        f" WHERE {'TRUE' if label != 'service' else column + chr(32) + '<> ' + chr(39) * 2} GROUP BY ALL"
        for label, column in _DIMENSIONS.items()
    )


def _windows(base: str, as_of: str, select: str) -> str:
    return f"""{base}, buckets AS ({_buckets()}), moment AS (SELECT {as_of} AS m),
spans(window_label, minutes) AS (VALUES ('5m', 5), ('10m', 10), ('30m', 30), ('60m', 60)),
summed AS (SELECT dimension, window_label, name, CAST(sum(bytes) AS BIGINT) AS bytes
  FROM buckets, spans, moment WHERE m - minute <= to_minutes(minutes) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension, window_label ORDER BY bytes DESC, name) AS rank,
  max(bytes) OVER (PARTITION BY dimension, window_label) AS largest FROM summed)
SELECT {select}, window_label AS "window", name, bytes,
  CASE WHEN largest > 0 THEN bytes * CAST(100 AS DOUBLE) / largest ELSE CAST(0 AS DOUBLE) END AS bar_pct
FROM ranked WHERE rank <= 10"""


def _one_dimension(label: str) -> str:
    whole = _windows(DENSE, "(SELECT max(event_ts) FROM silver)", "dimension")
    return f"SELECT \"window\", name, bytes, bar_pct FROM ({whole}) WHERE dimension = '{label}'"


_FOUND = "seq, event_ts, src_ip, dst_ip, src_port, dst_port, protocol, length, port_category"
_TEXT = "lower(concat_ws(' ', src_ip, dst_ip, CAST(src_port AS VARCHAR), CAST(dst_port AS VARCHAR), service_info))"


def _search(where: str, tail: str = "") -> str:
    return f"{SILVER} SELECT {_FOUND} FROM silver WHERE {where} {tail}"


def _private(ip: str) -> str:
    def octet(i: int) -> str:
        return f"TRY_CAST(split_part({ip}, '.', {i}) AS INT)"

    a, b = octet(1), octet(2)
    valid = " AND ".join(f"{octet(i)} BETWEEN 0 AND 255" for i in (1, 2, 3, 4))
    return (
        f"coalesce(len(string_split({ip}, '.')) = 4 AND {valid} AND ({a} = 10 OR ({a} = 172 AND {b} BETWEEN 16 AND 31)"
        f" OR ({a} = 192 AND {b} = 168) OR ({a} = 169 AND {b} = 254)), FALSE)"
    )


def _mask_ip(ip: str) -> str:
    return f"CASE WHEN {_private(ip)} THEN '{C.MASKED_IP}' ELSE {ip} END"


def _mask_port(ip: str, port: str) -> str:
    return f"CASE WHEN {_private(ip)} AND {port} IS NOT NULL THEN '{C.MASKED_PORT}' ELSE CAST({port} AS VARCHAR) END"


def _mask_subnet(net: str) -> str:
    return f"CASE WHEN {_private(f'''split_part({net}, '/', 1)''')} THEN '{C.MASKED_SUBNET}' ELSE {net} END"


_MASKED = f"""{_mask_ip('src_ip')} AS src_ip, {_mask_ip('dst_ip')} AS dst_ip,
 {_mask_port('src_ip', 'src_port')} AS src_port, {_mask_port('dst_ip', 'dst_port')} AS dst_port,
 {_mask_subnet('src_network')} AS src_network"""

# ---- JSON lines ---------------------------------------------------------

_MESSY = f"""WITH {_packets()}, cased AS (SELECT *, seq % 12 AS c FROM packets),
judged AS (SELECT *, list_filter([
   CASE WHEN c = 9 THEN 'record: not a JSON object' END,
   CASE WHEN c = 8 THEN 'src_ip: must be a string' END,
   CASE WHEN c IN (5, 6) THEN 'dst_port: must be an integer in range' END,
   CASE WHEN c = 3 THEN 'length: must be an integer in range' END,
   CASE WHEN c = 4 THEN 'length: field required' END,
   CASE WHEN c NOT IN (3, 4, 9) AND length < 0 THEN 'length: must be greater than or equal to 0' END
  ], lambda x: x IS NOT NULL) AS errors FROM cased),
valid AS (SELECT seq, timestamp, src_ip, dst_ip, src_port, dst_port,
   CASE WHEN c = 10 THEN 'OTHER' ELSE upper(protocol) END AS protocol, length,
   CASE WHEN c = 11 THEN 1 ELSE ttl END AS ttl, flags, agent_id, service_info, c FROM judged WHERE len(errors) = 0)"""

# ---- metrics ------------------------------------------------------------

_COUNTERS = """WITH history AS (SELECT 'agent_' || CAST(user_id % 5 AS VARCHAR) AS agent_id, event_id AS seq,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id * 100 END AS os_recv,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * (user_id % 5) END AS os_drop,
  CASE WHEN event_id % 7 = 0 THEN event_id END AS os_ifdrop, event_id * 90 AS app_queued FROM events),
latest AS (SELECT agent_id, coalesce(arg_max(os_recv, seq) FILTER (os_recv IS NOT NULL), 0) AS os_recv,
  coalesce(arg_max(os_drop, seq) FILTER (os_drop IS NOT NULL), 0) AS os_drop,
  coalesce(arg_max(os_ifdrop, seq) FILTER (os_ifdrop IS NOT NULL), 0) AS os_ifdrop,
  arg_max(app_queued, seq) AS app_queued, CAST(0 AS BIGINT) AS app_dropped FROM history GROUP BY {by}),
rated AS (SELECT *, round(CASE WHEN os_recv + os_drop > 0 THEN os_drop * CAST(100 AS DOUBLE) / (os_recv + os_drop)
  ELSE 0 END, 4) AS drop_rate_pct FROM latest),
health AS (SELECT *, CASE WHEN drop_rate_pct <= 0.5 THEN 'green' WHEN drop_rate_pct <= 2.0 THEN 'yellow' ELSE 'red' END
  AS status FROM rated)"""
_PER_AGENT = _COUNTERS.format(by="agent_id")
_OVERALL = _COUNTERS.replace("SELECT agent_id, coalesce", "SELECT coalesce").format(by="ALL")

# ---- manifest -----------------------------------------------------------

_ISO_TEXT = "%Y-%m-%dT%H:%M:%S.%f+00:00"
_SHOWN = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
_STEP = "least(event_id % 4, (event_id // 4) % 4)"
_MANIFEST = f"""WITH log AS (SELECT event_id AS seq,
  'bronze/capture_' || CAST(event_id // 4 AS VARCHAR) || '.ndjson' AS file_path,
  ['ACTIVE','SEALED','TRANSFERRED','ARCHIVED'][{_STEP} + 1] AS state,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(event_id // 64 AS BIGINT)), '%Y-%m-%d') AS partition_dt,
  CAST((event_id // 64) % 24 AS INT) AS partition_hr, {_SHOWN} AS created_at,
  CASE WHEN {_STEP} >= 1 THEN {_SHOWN} END AS sealed_at,
  CASE WHEN {_STEP} >= 2 THEN CASE WHEN (event_id // 4) % 10 = 2 THEN 'unknown' ELSE {_SHOWN} END END AS transferred_at,
  CAST(user_id * 1048576 AS BIGINT) AS size_bytes, CAST(floor(value * 10) AS BIGINT) AS record_count,
  'agent_' || CAST(user_id % 3 AS VARCHAR) AS agent_id FROM events),
current AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY seq DESC) = 1)"""

# ---- snapshot -----------------------------------------------------------


def _entries(breakdown: str, text: str) -> str:
    return f"(SELECT string_agg({text}, ',' ORDER BY rank) FROM breakdowns WHERE breakdown = '{breakdown}') AS {breakdown}"


_COUNTED = "name || ':' || packets"
_SIZED = "name || ':' || packets || ':' || bytes"
_SNAPSHOT = f"{SILVER}, {_RANKED_BREAKDOWNS}, {_OVERALL[5:]}"
_RECENT = "recent AS (SELECT * FROM silver ORDER BY seq DESC LIMIT 60)"
_WINDOW_60 = f"""(SELECT string_agg(protocol || ':' || b, ',' ORDER BY b DESC, protocol) FROM (
  SELECT protocol, CAST(sum(length) AS BIGINT) AS b FROM silver
  WHERE {_AS_OF} - date_trunc('minute', event_ts) <= to_minutes(60) GROUP BY protocol))"""

_TRAIL = f"trail AS ({_windows(SILVER, _AS_OF, 'dimension, rank')})"
_TRAILING = ", ".join(
    f"""(SELECT coalesce(string_agg(name || ':' || bytes, ',' ORDER BY rank), NULL) FROM trail
      WHERE dimension = '{d}' AND "window" = '{w}') AS {d}_{w}"""
    for d in _DIMENSIONS for w in ("5m", "10m", "30m", "60m")
)
_LAYER = "SELECT '{name}' AS layer, CAST({rows} AS BIGINT) AS rows, CAST({size} AS BIGINT) AS bytes FROM {source}"

# ---- frames -------------------------------------------------------------

_OCTETS = " || '.' || ".join(f"CAST(CAST(split_part({{ip}}, '.', {i}) AS INT) % 256 AS VARCHAR)" for i in (1, 2, 3, 4))
# Lengths follow from the way the frames are put together: link header, optional tag,
# IP header with optional options, transport header, payload, six bytes of padding.
_HOST = "'h' || lpad(CAST(seq % 50 AS VARCHAR), 2, '0')"
_FRAMES = f"""WITH {_packets()}, framed AS (SELECT p.seq, e.ts AS captured, seq % 16 AS c, upper(protocol) AS kind,
  p.* EXCLUDE (seq, dst_port), CASE WHEN seq % 3 <> 0 THEN dst_port WHEN dst_port = 9000 THEN 25 WHEN dst_port = 1900 THEN 8080
    ELSE dst_port END AS dst_port FROM packets p JOIN events e ON e.event_id = p.seq WHERE src_ip NOT LIKE 'fe80%'),
sized AS (SELECT *, CASE dst_port WHEN 443 THEN 76 WHEN 80 THEN 44 WHEN 53 THEN 33 WHEN 22 THEN 18 WHEN 25 THEN 28
    WHEN 8080 THEN 44 ELSE 3 END AS pay
  FROM framed WHERE c NOT IN (5, 7)),
known AS (SELECT *, (c <> 11 AND c <> 15 AND kind IN ('TCP', 'UDP')) AS ported FROM sized),
decoded AS (SELECT seq AS frame_id, strftime(captured, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp, captured,
  {_OCTETS.format(ip='src_ip')} AS src_ip, {_OCTETS.format(ip='dst_ip')} AS dst_ip,
  CASE WHEN ported THEN src_port END AS src_port, CASE WHEN ported THEN dst_port END AS dst_port,
  CASE WHEN c = 15 THEN 'PROTO_47' ELSE kind END AS protocol,
  CAST(14 + CASE WHEN c = 9 THEN 4 ELSE 0 END + 20 + CASE WHEN c = 13 THEN 4 ELSE 0 END + 6
    + CASE kind WHEN 'TCP' THEN 20 + pay WHEN 'UDP' THEN 8 + pay ELSE 12 END AS BIGINT) AS length,
  CAST(coalesce(ttl, 255) AS INT) AS ttl,
  CASE WHEN ported AND kind = 'TCP' THEN CASE WHEN flags = 'PA' THEN 'PA' ELSE 'S' END END AS flags,
  CASE WHEN NOT ported THEN NULL
    WHEN kind = 'TCP' AND dst_port = 443 THEN 'HTTPS/TLS SNI=' || {_HOST} || '.example.com'
    WHEN kind = 'TCP' AND dst_port = 80 THEN 'HTTP GET ' || {_HOST} || '.example.com/p/' || CAST(seq % 7 AS VARCHAR)
    WHEN kind = 'UDP' AND dst_port = 53 THEN CASE WHEN seq % 4 = 2 THEN 'DNS A ' ELSE 'DNS AAAA ' END
      || {_HOST} || '.example.com'
    WHEN kind = 'TCP' AND dst_port = 25 THEN '220 mail.example.com ready'
    WHEN kind = 'TCP' AND dst_port = 8080 THEN 'HTTP 200 text/html'
    WHEN kind = 'TCP' AND dst_port = 22 THEN 'SSH-2.0-Demo_1.0' END AS service_info FROM known)"""

_SLOT = "CAST(dayofweek(event_ts) + 1 AS INT) AS weekday, CAST(hour(event_ts) AS INT) AS hour"
_PER_HOUR = f"""per_hour AS (SELECT date_trunc('hour', event_ts) AS hour_start, {_SLOT}, {_SUMS} FROM silver GROUP BY ALL)"""
_PROFILE = """profile AS (SELECT weekday, hour, count(*) AS hours_seen,
  avg(packets) AS mean_packets, avg(bytes) AS mean_bytes FROM per_hour GROUP BY ALL)"""


def _profile_top(key: str, limit: int) -> str:
    return f"""{SILVER}, grouped AS (SELECT {_SLOT}, {key}, count(*) AS packets FROM silver WHERE {key} IS NOT NULL GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY weekday, hour ORDER BY packets DESC, {key}) AS rank FROM grouped
        QUALIFY rank <= {limit}"""


def _new_top(key: str) -> str:
    return f"""{SILVER} SELECT {key}, count(*) AS packets FROM silver
        WHERE {key} NOT IN (SELECT {key} FROM silver WHERE event_date < DATE '2024-01-02')
        GROUP BY {key} ORDER BY packets DESC, {key} LIMIT 50"""


_HOURLY_VOLUME = f"volume AS (SELECT date_trunc('hour', event_ts) AS window_start, {_SUMS} FROM silver GROUP BY ALL)"

_PERIODIC = " UNION ALL ".join(
    f"SELECT event_date, length, '{label}' AS breakdown, CAST({column} AS VARCHAR) AS name FROM silver"
    for label, column in (
        ("protocol", "protocol"), ("src_ip", "src_ip"), ("dst_ip", "dst_ip"), ("subnet", "src_network"), ("dst_port", "dst_port")
    )
)

ORACLES: dict[str, str] = {
    "silver_packets": f"{SILVER} SELECT seq, {_SILVER_COLUMNS} FROM silver",
    "silver_utc_buckets": f"""WITH {_packets()}, {_VALID}, {_silver_from(
        'valid', 'CAST(wall - to_minutes(off_min) AS DATE)', "date_trunc('hour', wall - to_minutes(off_min))")}
        SELECT seq, event_ts, event_hour, event_date FROM silver""",
    "quarantine_rows": f"""WITH {_packets()} SELECT seq, 'length: must be greater than or equal to 0' AS reason
        FROM packets WHERE length < 0""",
    "validated_json": f"""{_MESSY} SELECT * EXCLUDE (c),
        CASE WHEN c = 7 THEN '{{"vlan":' || CAST(seq AS VARCHAR) || '}}' END AS _rescued_data FROM valid""",
    "rejected_json": f"""{_MESSY} SELECT seq, array_to_string(errors, '; ') AS reason,
        CASE c WHEN 3 THEN '{{"length":' || CAST(abs(length) AS VARCHAR) || '.5}}'
          WHEN 5 THEN '{{"dst_port":"eighty"}}' WHEN 6 THEN '{{"dst_port":4294967296}}'
          WHEN 7 THEN '{{"vlan":' || CAST(seq AS VARCHAR) || '}}' WHEN 8 THEN '{{"src_ip":167772161}}' END AS _rescued_data
        FROM judged WHERE len(errors) > 0""",
    "bronze_roundtrip": f"""WITH {_packets()} SELECT timestamp, src_ip, dst_ip, src_port, dst_port,
        upper(protocol) AS protocol, length, ttl, flags, agent_id, service_info, DATE '2024-01-30' AS dt,
        CAST(23 AS INT) AS hr FROM packets WHERE length >= 0""",
    "partition_filter": f"{SILVER} SELECT seq, event_date, length FROM silver WHERE event_date = DATE '2024-01-15'",
    "gold_hourly": f"{SILVER} {_GOLD}",
    "gold_hourly_dense": f"{DENSE} {_GOLD}",
    "gold_partial_merge": f"{DENSE} SELECT {_ADDITIVE} FROM silver GROUP BY ALL",
    "gold_sketch_error": f"{DENSE} SELECT count(*) AS gold_rows, CAST(0 AS BIGINT) AS rows_off FROM ({_GOLD})",
    "gold_by_protocol": f"{DENSE}, {_BY_PROTOCOL} SELECT * FROM by_protocol",
    "gold_busiest": f"{DENSE}, {_BY_PROTOCOL} SELECT * FROM by_protocol ORDER BY packets DESC, protocol LIMIT 2",
    "traffic_totals": f"{SILVER} SELECT {_SUMS} FROM silver",
    "protocol_breakdown": _share(
        _top("protocol", 10, "TRUE", _SUMS), f", CAST(bytes AS DOUBLE) / packets AS avg_size, {_human('bytes')} AS size"
    ),
    "top_src_ips": _share(_top("src_ip", 10)),
    "top_dst_ips": _share(_top("dst_ip", 10)),
    "top_subnets": _share(_top("src_network", 10)),
    "top_dst_ports": f"{SILVER} {_top('dst_port', 10, 'dst_port IS NOT NULL')}",
    "port_stats": f"{SILVER} {_top('dst_port, protocol', 30, 'dst_port IS NOT NULL', _SUMS)}",
    "service_stats": f"""{SILVER} {_top('service_info', 10, "service_info <> ''", _SUMS)}""",
    "live_breakdowns": f"{SILVER}, {_RANKED_BREAKDOWNS} SELECT * FROM breakdowns",
    "port_view_all": _port_view("TRUE"),
    "port_view_hide_os_noise": _port_view(f"dst_port NOT IN {_ports(C.OS_NOISE_PORTS)}"),
    "port_view_only_well_known": _port_view(f"dst_port IN {_ports(C.PORT_SERVICES)}"),
    "minute_buckets": f"{DENSE} {_buckets()}",
    "protocol_windows": _one_dimension("protocol"),
    "subnet_windows": _one_dimension("subnet"),
    "service_windows": _one_dimension("service"),
    "trailing_windows_fixed": _windows(SILVER, _AS_OF, "dimension, rank"),
    "recent_packets": f"{SILVER} SELECT {_FOUND} FROM silver ORDER BY seq DESC LIMIT 60",
    "packet_search_proto": _search("protocol = 'TCP'"),
    "packet_search_subnet": _search("src_ip LIKE '192.168.1.%' AND len(string_split(src_ip, '.')) = 4"),
    "packet_search_subnet_octet": _search("src_ip LIKE '10.%' AND len(string_split(src_ip, '.')) = 4"),
    "packet_search_ports": _search("dst_port BETWEEN 80 AND 5353"),
    "packet_search_category": _search("port_category = 'os_noise'"),
    "packet_search_text": _search(f"contains({_TEXT}, 'example.com')"),
    "packet_search_combined": _search(
        f"contains({_TEXT}, '203.0') AND protocol = 'UDP' AND dst_port >= 50 AND port_category = 'well_known'"
    ),
    "packet_search_largest": _search("protocol = 'UDP'", "ORDER BY length DESC, seq LIMIT 25"),
    "packet_search_newest": _search("TRUE", "ORDER BY event_ts DESC, seq LIMIT 25"),
    "packet_search_predicate": _search("protocol = 'TCP' AND (src_port = 80 OR dst_port = 80)"),
    "anonymized_packets": f"{SILVER} SELECT seq, {_MASKED} FROM silver",
    "private_addresses": f"""{SILVER} SELECT {_private('src_ip')} AS is_private, count(*) AS packets,
        count(DISTINCT src_ip) AS addresses FROM silver GROUP BY 1""",
    "live_rows": f"""{SILVER} SELECT seq, strftime(event_ts, '%H:%M:%S.%g') AS time,
        concat_ws(':', src_ip, src_port) AS source, concat_ws(':', dst_ip, dst_port) AS destination FROM silver""",
    # All rows lie in winter, when Paris is one hour ahead of UTC.
    "live_rows_in_zone": f"""{SILVER} SELECT seq, strftime(event_ts + INTERVAL 1 HOUR, '%H:%M:%S.%g') AS time FROM silver""",
    "stage_counters": f"""{SILVER} SELECT (SELECT count(*) FROM packets) AS captured, (SELECT count(*) FROM valid) AS processed,
        (SELECT count(*) FROM packets WHERE length < 0) AS validation_errors, count(*) AS silver_records FROM silver""",
    "latency_percentiles": """WITH samples AS (SELECT
        ['capture_to_queue','queue_to_bronze','bronze_to_silver','silver_to_gold','other'][event_id % 5 + 1] AS stage,
        value AS us, event_id AS seq FROM events),
        kept AS (SELECT * FROM samples WHERE stage <> 'other'
          QUALIFY row_number() OVER (PARTITION BY stage ORDER BY seq DESC) <= 1000),
        listed AS (SELECT stage, list(us ORDER BY us) AS l, count(*) AS n FROM kept GROUP BY stage)
        SELECT stage, n AS samples, round(l[least(n * 50 // 100, n - 1) + 1], 1) AS p50,
        round(l[least(n * 95 // 100, n - 1) + 1], 1) AS p95, round(l[least(n * 99 // 100, n - 1) + 1], 1) AS p99 FROM listed""",
    "throughput_rate": f"""{DENSE}, moment AS (SELECT max(event_ts) AS m FROM silver)
        SELECT round(count(*) / CAST(10 AS DOUBLE), 1) AS packets_per_sec FROM silver, moment
        WHERE event_ts BETWEEN m - INTERVAL 10 SECOND AND m""",
    "gauge_values": """SELECT 'gauge_' || CAST(user_id % 6 AS VARCHAR) AS gauge, arg_max(event_id * 10, event_id) AS value
        FROM events WHERE event_id % 4 <> 0 GROUP BY 1""",
    "capture_health": f"{_PER_AGENT} SELECT * FROM health",
    "drop_rate_alerts": f"{_PER_AGENT} SELECT agent_id, drop_rate_pct, status FROM health WHERE drop_rate_pct > 2.0",
    "recent_errors": """SELECT ts, 'component_' || CAST(user_id % 4 AS VARCHAR) AS component, 'failed: ' || props AS error
        FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10""",
    "data_age": f"""{SILVER}, age AS (SELECT greatest(CAST(0 AS DOUBLE),
        (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(event_ts))) / CAST(1000000 AS DOUBLE)) AS age_sec FROM silver)
        SELECT age_sec, age_sec <= 10 AS healthy FROM age""",
    "manifest_current": f"{_MANIFEST} SELECT * FROM current",
    "pending_transfer": f"{_MANIFEST} SELECT file_path, size_bytes, record_count FROM current WHERE state = 'SEALED'",
    "store_stats": f"""{_MANIFEST} SELECT state, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes,
        CAST(sum(record_count) AS BIGINT) AS records FROM current GROUP BY state""",
    "compaction_candidates": f"""{_MANIFEST} SELECT partition_dt, partition_hr, count(*) AS files,
        CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(sum(record_count) AS BIGINT) AS record_count FROM current
        WHERE state = 'SEALED' AND size_bytes < 104857600 GROUP BY ALL HAVING count(*) >= 2""",
    "retention_candidates": f"""{_MANIFEST} SELECT file_path, transferred_at FROM current WHERE state = 'TRANSFERRED'
        AND TRY_CAST(replace(transferred_at, '+00:00', '') AS TIMESTAMP) < {_AS_OF} - INTERVAL 72 HOUR""",
    "manifest_transitions": f"""{_MANIFEST}, bounds AS (SELECT max(seq) + 1 AS next FROM log)
        SELECT CASE WHEN state IN ('ACTIVE', 'SEALED') THEN next ELSE seq END AS seq, file_path,
        CASE state WHEN 'ACTIVE' THEN 'SEALED' WHEN 'SEALED' THEN 'TRANSFERRED' ELSE state END AS state,
        CASE WHEN state = 'ACTIVE' THEN 7 ELSE size_bytes END AS size_bytes,
        CASE WHEN state = 'ACTIVE' THEN 3 ELSE record_count END AS record_count FROM current, bounds""",
    "live_snapshot": f"""{_SNAPSHOT} SELECT (SELECT count(*) FROM silver) AS total_packets,
        (SELECT CAST(sum(length) AS BIGINT) FROM silver) AS total_bytes,
        {_entries('protocols', _SIZED)}, {_entries('top_src_ips', _COUNTED)}, {_entries('top_dst_ips', _COUNTED)},
        {_entries('top_subnets', _COUNTED)}, {_entries('top_dst_ports', _COUNTED)},
        {_entries('port_stats', "name || ':' || protocol || ':' || packets || ':' || bytes")}, {_entries('services', _SIZED)},
        (SELECT least(60, count(*)) FROM silver) AS recent, (SELECT count(DISTINCT protocol) FROM silver) AS gold_protocols,
        drop_rate_pct, {_WINDOW_60} AS protocol_60m FROM health""",
    "live_snapshot_from_state": f"""{_SNAPSHOT}, {_RECENT}, {_TRAIL}, {_BY_PROTOCOL} SELECT
        strftime({_AS_OF}, '{_ISO_TEXT}') AS snapshot_at, strftime({_AS_OF}, '{_ISO_TEXT}') AS started_at,
        (SELECT count(*) FROM silver) AS total_packets, (SELECT CAST(sum(length) AS BIGINT) FROM silver) AS total_bytes,
        {_entries('protocols', _SIZED)}, {_entries('top_src_ips', _COUNTED)}, {_entries('top_dst_ips', _COUNTED)},
        {_entries('top_subnets', _COUNTED)}, {_entries('top_dst_ports', _COUNTED)},
        {_entries('port_stats', "name || ':' || protocol || ':' || packets || ':' || bytes")}, {_entries('services', _SIZED)},
        (SELECT string_agg(concat_ws(':', strftime(event_ts, '{_ISO_TEXT}'), src_ip, dst_ip, src_port, dst_port, protocol, length,
          flags, ttl, service_info, port_category, src_network), ',' ORDER BY seq) FROM recent) AS recent_packets,
        {_TRAILING},
        (SELECT string_agg(concat_ws(':', protocol, packets, bytes, src, dst, ports), ',' ORDER BY protocol) FROM by_protocol) AS gold,
        os_recv, os_drop, os_ifdrop, app_queued, app_dropped, drop_rate_pct FROM health""",
    "metrics_document": f"""{DENSE}, {_OVERALL[5:]}, moment AS (SELECT max(event_ts) AS m FROM silver),
        sparse AS ({SILVER} SELECT (SELECT count(*) FROM packets) AS captured, (SELECT count(*) FROM valid) AS processed,
          (SELECT count(*) FROM packets WHERE length < 0) AS validation_errors, count(*) AS silver_records FROM silver),
        samples AS (SELECT ['capture_to_queue','queue_to_bronze','bronze_to_silver','silver_to_gold','other'][event_id % 5 + 1]
          AS stage, value AS us, ts, event_id AS seq FROM events),
        kept AS (SELECT * FROM samples WHERE stage <> 'other'
          QUALIFY row_number() OVER (PARTITION BY stage ORDER BY ts DESC, seq DESC) <= 1000),
        listed AS (SELECT stage, list(us ORDER BY us) AS l, count(*) AS n FROM kept GROUP BY stage),
        stages AS (SELECT stage, [format('{{:.1f}}', round(l[least(n * p // 100, n - 1) + 1], 1)) FOR p IN [50, 95, 99]] AS picks FROM listed),
        errors AS (SELECT ts, event_id AS seq, concat_ws('|', strftime(ts, '{_ISO_TEXT}'), 'component_' || CAST(user_id % 4 AS VARCHAR),
          'failed: ' || props) AS entry FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10)
        SELECT round((epoch_us(m) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / CAST(1000000 AS DOUBLE), 1) AS uptime_sec,
        captured, CAST(0 AS BIGINT) AS parsed, app_queued AS queued, app_dropped AS dropped, processed, validation_errors,
        silver_records, (SELECT count(*) FROM events WHERE event_type = 'click') AS silver_flushes,
        (SELECT count(*) FROM events WHERE event_type = 'view') AS gold_flushes, CAST(0 AS BIGINT) AS snapshot_flushes,
        (SELECT round(count(*) / CAST(10 AS DOUBLE), 1) FROM silver WHERE event_ts BETWEEN m - INTERVAL 10 SECOND AND m)
          AS packets_per_sec,
        (SELECT arg_max(event_id * 10, event_id) FROM events WHERE event_id % 4 <> 0 AND user_id % 6 = 0) AS queue_depth,
        (SELECT string_agg(stage || ':' || array_to_string(picks, ':'), ',' ORDER BY stage) FROM stages) AS latency_us,
        (SELECT string_agg(entry, chr(10) ORDER BY ts, seq) FROM errors) AS recent_errors
        FROM sparse, rated, moment""",
    "gold_state_folded": f"""{_MESSY}, {_silver_from('valid')}, gold AS ({_GOLD}) SELECT count(*) AS gold_rows,
        CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(total_bytes) AS BIGINT) AS bytes,
        CAST(sum(unique_src_ips) AS BIGINT) AS src, CAST(sum(unique_dst_ips) AS BIGINT) AS dst,
        CAST(sum(unique_dst_ports) AS BIGINT) AS ports,
        CAST(count(*) + sum(unique_src_ips) + sum(unique_dst_ips) + sum(unique_dst_ports) AS BIGINT) AS state_rows FROM gold""",
    "stream_all_layers": f"""{_MESSY}, {_silver_from('valid')}, gold AS ({_GOLD}),
        bad AS (SELECT * FROM judged WHERE len(errors) > 0) {' UNION ALL '.join(
            _LAYER.format(name=n, rows=r, size=b, source=t) for n, r, b, t in (
                ('bronze', 'count(*)', 'sum(length)', 'valid'), ('manifest', 'count(*)', '0', 'valid'),
                ('quarantine', 'count(*)', '0', 'bad'), ('silver', 'count(*)', 'sum(length)', 'silver'),
                ('gold', 'count(*)', 'sum(total_bytes)', 'gold'), ('live', 'count(*)', 'sum(length)', 'silver'),
                ('live_recent', 'least(60, count(*))', '0', 'silver'), ('processed', 'count(*)', '0', 'valid'),
                ('errors', 'count(*)', '0', 'bad'), ('silver_records', 'count(*)', '0', 'silver'),
                ('published', '1', '0', '(SELECT 1)')))}""",
    "live_snapshot_masked": f"""{_SNAPSHOT}, {_RECENT} SELECT
        {_entries('top_src_ips', _mask_ip('name') + " || ':' || packets")},
        {_entries('top_subnets', _mask_subnet('name') + " || ':' || packets")},
        (SELECT string_agg(concat_ws(':', {_mask_ip('src_ip')}, {_mask_port('src_ip', 'src_port')},
          {_mask_port('dst_ip', 'dst_port')}), ',' ORDER BY seq) FROM recent) AS recent_packets""",
    "snapshot_document_roundtrip": f"""{_SNAPSHOT} SELECT (SELECT count(*) FROM silver) AS total_packets,
        (SELECT CAST(sum(length) AS BIGINT) FROM silver) AS total_bytes, {_entries('protocols', _SIZED)},
        (SELECT least(60, count(*)) FROM silver) AS recent""",
    "health_status": f"""{_SNAPSHOT} SELECT status, drop_rate_pct, os_recv, os_drop,
        (SELECT count(*) FROM packets) AS captured, (SELECT count(*) FROM silver) AS silver_records FROM health""",
    "silver_table_scan": f"""{SILVER} SELECT event_date, {_SUMS} FROM silver WHERE event_date >= DATE '2024-01-20'
        GROUP BY event_date""",
    "schema_evolution_read": f"""{SILVER}, kept AS (SELECT event_date,
        CASE WHEN seq % 3 = 2 AND seq % 2 = 0 THEN NULL ELSE length END AS length,
        CASE WHEN seq % 3 = 1 THEN NULL ELSE service_info END AS service_info FROM silver)
        SELECT event_date, count(*) AS packets, count(length) AS lengths, CAST(sum(length) AS BIGINT) AS bytes,
        count(service_info) AS services FROM kept GROUP BY event_date""",
    "schema_evolution_strict": f"""{SILVER}, marked AS (SELECT *, day(event_date) % 2 = 1 AND seq % 2 = 0 AS bad FROM silver)
        SELECT event_date, count(*) AS packets,
        CASE WHEN bool_or(bad) THEN 0 ELSE count(length) END AS lengths,
        CASE WHEN NOT bool_or(bad) THEN CAST(sum(length) AS BIGINT) END AS bytes FROM marked GROUP BY event_date""",
    "compacted_silver": f"{SILVER} SELECT event_date, {_SUMS}, CAST(1 AS BIGINT) AS most_files FROM silver GROUP BY event_date",
    "retained_silver": f"""{SILVER} SELECT event_date, count(*) AS packets FROM silver
        WHERE event_date >= DATE '2024-01-23' GROUP BY event_date""",
    "compacted_bronze": f"""WITH {_packets()} SELECT count(*) AS records, CAST(1 AS BIGINT) AS hours, count(*) AS lines
        FROM packets WHERE length >= 0""",
    "retained_bronze": f"""WITH {_packets()} SELECT 'ARCHIVED' AS state, count(*) AS records, CAST(0 AS BIGINT) AS lines_left
        FROM packets WHERE length >= 0""",
    "stream_gold": f"{_MESSY}, {_silver_from('valid')} {_GOLD}",
    "stream_gold_late": f"{_MESSY}, {_silver_from('valid')} {_GOLD}",
    "stream_silver": f"{_MESSY}, {_silver_from('valid')} SELECT {_SILVER_COLUMNS} FROM silver",
    "stream_quarantine": f"""{_MESSY} SELECT array_to_string(errors, '; ') AS reason, count(*) AS records
        FROM judged WHERE len(errors) > 0 GROUP BY 1""",
    "stream_minutes": f"""{SILVER} SELECT date_trunc('minute', event_ts) AS minute, protocol, {_SUMS} FROM silver
        GROUP BY ALL""",
    "table_append": f"{_MESSY}, {_silver_from('valid')} SELECT {_SILVER_COLUMNS} FROM silver",
    "stored_summary": f"""{SILVER}, gold AS ({_GOLD}) SELECT 'silver' AS layer, count(*) AS rows FROM silver
        UNION ALL SELECT 'gold', count(*) FROM gold""",
    "stored_gold_preview": f"""{SILVER} {_GOLD}
        ORDER BY event_hour, event_date, protocol NULLS FIRST, src_network NULLS FIRST, agent_id NULLS FIRST LIMIT 20""",
    "stream_protocol_totals": f"{SILVER} SELECT protocol, {_SUMS} FROM silver GROUP BY protocol",
    "stream_windows": _windows(DENSE, "(SELECT max(event_ts) FROM silver)", "dimension, rank"),
    "frame_decode": f"{_FRAMES} SELECT * EXCLUDE (captured) FROM decoded",
    "frame_to_gold": f"""{_FRAMES}, silver AS (SELECT *, captured AS event_ts, date_trunc('hour', captured) AS event_hour,
        CAST(captured AS DATE) AS event_date, 'tap' AS agent_id,
        array_to_string(string_split(src_ip, '.')[1:3], '.') || '.0/24' AS src_network FROM decoded) {_GOLD}""",
    "volume_vs_previous_day": f"""{SILVER}, {_HOURLY_VOLUME} SELECT n.*, b.packets AS packets_before, b.bytes AS bytes_before,
        CASE WHEN b.bytes > 0 THEN (n.bytes - b.bytes) * CAST(100 AS DOUBLE) / b.bytes END AS change_pct
        FROM volume n LEFT JOIN volume b ON b.window_start + INTERVAL 24 HOUR = n.window_start""",
    "new_top_talkers": _new_top("src_ip"),
    "new_top_destinations": _new_top("dst_ip"),
    "hour_weekday_profile": f"""{SILVER}, {_PER_HOUR}, {_PROFILE} SELECT weekday, hour, hours_seen, mean_packets, mean_bytes
        FROM profile""",
    "profile_top_ports": _profile_top("dst_port", 3),
    "profile_top_src_ips": _profile_top("src_ip", 3),
    "profile_protocol_mix": f"""{SILVER}, grouped AS (SELECT {_SLOT}, protocol, count(*) AS packets FROM silver GROUP BY ALL)
        SELECT *, packets * CAST(100 AS DOUBLE) / sum(packets) OVER (PARTITION BY weekday, hour) AS pct FROM grouped""",
    "profile_deviation": f"""{SILVER}, {_PER_HOUR}, {_PROFILE} SELECT hour_start, weekday, hour, packets, bytes, mean_bytes,
        CASE WHEN mean_bytes > 0 THEN bytes / mean_bytes END AS ratio FROM per_hour JOIN profile USING (weekday, hour)""",
    "flows": f"""{SILVER} SELECT src_ip, dst_ip, src_port, dst_port, protocol, {_SUMS}, min(event_ts) AS first_seen,
        max(event_ts) AS last_seen, (epoch_us(max(event_ts)) - epoch_us(min(event_ts))) / CAST(1000000 AS DOUBLE)
        AS duration_sec FROM silver GROUP BY ALL""",
    "flow_sessions": f"""{DENSE}, marked AS (SELECT src_network AS src_ip, protocol, length, event_ts,
        CASE WHEN epoch_us(event_ts) - epoch_us(lag(event_ts) OVER w) < 120000000 THEN 0 ELSE 1 END AS starts
        FROM silver WINDOW w AS (PARTITION BY src_network, protocol ORDER BY event_ts)),
        numbered AS (SELECT *, sum(starts) OVER (PARTITION BY src_ip, protocol ORDER BY event_ts ROWS UNBOUNDED PRECEDING)
        AS session FROM marked)
        SELECT src_ip, protocol, {_SUMS}, min(event_ts) AS first_seen, max(event_ts) AS last_seen,
        (epoch_us(max(event_ts)) - epoch_us(min(event_ts))) / CAST(1000000 AS DOUBLE) AS duration_sec
        FROM numbered GROUP BY src_ip, protocol, session""",
    "main_service": f"""{SILVER} SELECT src_ip, service_info, count(*) AS packets FROM silver WHERE service_info <> ''
        GROUP BY src_ip, service_info
        QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY packets DESC, service_info) = 1""",
    "subnet_report": f"""{SILVER}, per_port AS (SELECT src_network, dst_port, {_SUMS} FROM silver
        WHERE dst_port IS NOT NULL GROUP BY ALL),
        best AS (SELECT *, row_number() OVER (PARTITION BY src_network ORDER BY packets DESC, dst_port) AS rank FROM per_port
        QUALIFY rank <= 3),
        whole AS (SELECT src_network, count(*) AS subnet_packets, CAST(sum(length) AS BIGINT) AS subnet_bytes FROM silver
        GROUP BY src_network) SELECT * FROM whole LEFT JOIN best USING (src_network)""",
    "last_hours": f"""{SILVER} SELECT src_ip, dst_port, service_info, {_SUMS} FROM silver
        WHERE event_ts BETWEEN {_AS_OF} - INTERVAL 24 HOUR AND {_AS_OF} GROUP BY ALL""",
    "weekly_report": f"{SILVER} SELECT CAST(date_trunc('week', event_date) AS DATE) AS period, {_SUMS} FROM silver GROUP BY 1",
    "periodic_export": f"""{SILVER}, named AS ({_PERIODIC}),
        counted AS (SELECT unit, CAST(date_trunc(unit, event_date) AS DATE) AS period, breakdown, name, {_SUMS}
          FROM named, (VALUES ('day'), ('week')) u(unit) GROUP BY ALL),
        whole AS (SELECT unit, period, breakdown, count(DISTINCT name) AS names, CAST(sum(packets) AS BIGINT) AS period_packets,
          CAST(sum(bytes) AS BIGINT) AS period_bytes FROM counted GROUP BY ALL)
        SELECT c.*, row_number() OVER (PARTITION BY unit, period, breakdown ORDER BY c.packets DESC, name) AS rank, names,
          period_packets, period_bytes FROM counted c JOIN whole USING (unit, period, breakdown) WHERE name IS NOT NULL
        QUALIFY rank <= 10""",
    "hours_export": f"""{SILVER} SELECT src_ip, dst_port, service_info, {_SUMS} FROM silver
        WHERE event_ts BETWEEN {_AS_OF} - INTERVAL 24 HOUR AND {_AS_OF} GROUP BY ALL""",
    "flow_sessions_by_tuple": f"""{DENSE}, marked AS (SELECT *,
        CASE WHEN epoch_us(event_ts) - epoch_us(lag(event_ts) OVER w) < 120000000 THEN 0 ELSE 1 END AS starts
        FROM silver WINDOW w AS (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY event_ts)),
        numbered AS (SELECT *, sum(starts) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY event_ts
        ROWS UNBOUNDED PRECEDING) AS session FROM marked)
        SELECT src_ip, dst_ip, src_port, dst_port, protocol, {_SUMS}, min(event_ts) AS first_seen, max(event_ts) AS last_seen,
        (epoch_us(max(event_ts)) - epoch_us(min(event_ts))) / CAST(1000000 AS DOUBLE) AS duration_sec
        FROM numbered GROUP BY src_ip, dst_ip, src_port, dst_port, protocol, session""",
    "volume_spikes_by_source": f"""{DENSE}, per AS (SELECT src_ip, dst_port, time_bucket(INTERVAL 360 MINUTE, event_ts)
        AS window_start, CAST(sum(length) AS BIGINT) AS bytes FROM silver WHERE dst_port IS NOT NULL GROUP BY ALL),
        scored AS (SELECT *, avg(bytes) OVER w AS m, stddev_samp(bytes) OVER w AS s FROM per
        WINDOW w AS (PARTITION BY src_ip, dst_port ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
        SELECT src_ip, dst_port, window_start, bytes FROM scored WHERE bytes > m + s""",
    "silver_ingested": f"""{SILVER} SELECT event_date, {_AS_OF} AS ingested_at, count(*) AS packets FROM silver
        GROUP BY event_date""",
    "window_breakdown": f"""{SILVER} SELECT protocol, {_SUMS} FROM silver WHERE event_ts >= TIMESTAMP '2024-01-10'
        AND event_ts < TIMESTAMP '2024-01-12' GROUP BY protocol""",
    "volume_spikes": f"""{DENSE}, per AS (SELECT src_network AS src_ip, dst_port, time_bucket(INTERVAL 10 MINUTE, event_ts)
        AS window_start, CAST(sum(length) AS BIGINT) AS bytes FROM silver WHERE dst_port IS NOT NULL GROUP BY ALL),
        scored AS (SELECT *, avg(bytes) OVER w AS m, stddev_samp(bytes) OVER w AS s FROM per
        WINDOW w AS (PARTITION BY src_ip, dst_port ORDER BY window_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
        SELECT src_ip, dst_port, window_start, bytes FROM scored WHERE bytes > m + 1.5 * s""",
    "ephemeral_fanout": f"""{SILVER} SELECT src_ip, count(*) AS packets, count(DISTINCT dst_ip) AS targets,
        count(DISTINCT src_port) AS src_ports FROM silver WHERE src_port > 32768 AND dst_port IN (80, 443) GROUP BY src_ip""",
    "ttl_distribution": f"{SILVER} SELECT ttl, count(*) AS packets FROM silver WHERE ttl IS NOT NULL GROUP BY ttl",
    "low_ttl_share": f"""{SILVER} SELECT count(ttl) AS packets, count(*) FILTER (ttl < 65) AS low,
        count(*) FILTER (ttl < 65) * CAST(100 AS DOUBLE) / count(ttl) AS low_pct FROM silver""",
}
ORACLES["stream_latency"] = ORACLES["latency_percentiles"]
