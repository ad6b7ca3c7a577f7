"""The same queries as SQL over the `events` table, written independently for DuckDB."""

from __future__ import annotations

from airsift import labels as L
from airsift.schema import FIELD_CANDIDATES, SEQ_MISSING
from airsift.sources.events import FRAMES_FROM_EVENTS
from parity.queries import BUSY_FROM

_MAC = "'([0-9a-f]{2}:){5}[0-9a-f]{2}'"


def _valid(c: str) -> str:
    return f"regexp_full_match({c}, {_MAC})"


def _ignored(c: str) -> str:
    return f"({c} = '' OR {c} = 'ff:ff:ff:ff:ff:ff' OR {c} LIKE '01:00:5e%' OR {c} LIKE '33:33%')"


def _first(c: str) -> str:
    return f"trim(split_part({c}, ',', 1))"


def _double(c: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({c}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)"
        f"([eE][+-]?[0-9]+)?') THEN try_cast({c} AS DOUBLE) END"
    )


def _decoded(c: str) -> str:
    raw = f"try(decode(unhex(replace({c}, ' ', ''))))"
    return (
        f"CASE WHEN {c} = '' THEN '{L.HIDDEN_SSID}' WHEN length({c}) % 2 = 0 "
        f"AND regexp_full_match({c}, '(\\s*[0-9a-fA-F]{{2}})+\\s*') "
        f"AND regexp_full_match({raw}, '([^\\p{{C}}\\p{{Z}}]| )+') THEN {raw} ELSE {c} END"
    )


def _local(mac: str) -> str:
    octet = f"try_cast('0x' || split_part({mac}, ':', 1) AS INT)"
    return f"coalesce(({octet} & 2) <> 0, false)"


def _oui(mac: str) -> str:
    return (
        f"CASE WHEN len(string_split({mac}, ':')) >= 3 "
        f"THEN array_to_string(string_split(upper({mac}), ':')[1:3], ':') ELSE '' END"
    )


def _vendor(mac: str) -> str:
    return (
        f"CASE WHEN {mac} = '' THEN 'Bilinmiyor' WHEN {_local(mac)} "
        "THEN 'Private / Randomized MAC' ELSE coalesce(vendor, 'Bilinmiyor') END"
    )


def _clock(ts: str) -> str:
    micros = f"CAST(round_even({ts} * 1000000, 0) AS BIGINT)"
    return f"coalesce(strftime(make_timestamp({micros}), '%H:%M:%S'), '—')"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


_FRAMES = FRAMES_FROM_EVENTS.replace("{us}", "epoch_us(ts)").replace("{events}", "events")

COMMON = f"""
WITH frames AS (:frames),
oui AS (SELECT * FROM (VALUES {_values(L.OUI_VENDORS)}) t(oui, vendor)),
subtype_names AS (SELECT * FROM (VALUES {_values(L.SUBTYPE_NAMES)}) t(code, name)),
norm AS (
  SELECT capture_id,
    coalesce(try_cast({_first('frame_number')} AS BIGINT), {SEQ_MISSING}) AS seq,
    {_first('frame_number')} AS frame_number,
    {_first('timestamp')} AS ts_raw,
    {_double(_first('timestamp'))} AS ts,
    {_first('frame_subtype')} AS sub,
    lower({_first('source')}) AS src, {_valid("lower(" + _first('source') + ")")} AS src_ok,
    lower({_first('destination')}) AS dst, {_valid("lower(" + _first('destination') + ")")} AS dst_ok,
    lower({_first('bssid')}) AS bssid, {_valid("lower(" + _first('bssid') + ")")} AS bssid_ok,
    {_first('ssid')} AS ssid,
    {_first('channel')} AS channel,
    CAST(trunc({_double(_first('signal'))}) AS INT) AS sig,
    {_first('eapol_type')} AS eapol
  FROM frames),
named AS (SELECT * FROM norm WHERE {_valid('bssid')}),
ends AS (
  SELECT * FROM (
    SELECT *, src AS mac, 0 AS side FROM named
    UNION ALL SELECT *, dst AS mac, 1 AS side FROM named)
  WHERE {_valid('mac')} AND mac <> bssid AND NOT {_ignored('mac')}),
raw_clients AS (
  SELECT capture_id, bssid, mac, count(*) AS packet_count,
    count(*) FILTER (mac = src) AS sent_packets,
    count(*) FILTER (mac = dst) AS received_packets,
    min(2 * seq + side) AS first_order,
    arg_min(ts, seq) FILTER (ts IS NOT NULL) AS ts1,
    arg_max(ts, seq) FILTER (ts IS NOT NULL) AS ts2
  FROM ends GROUP BY ALL),
clients AS (
  SELECT capture_id, bssid, mac, {_vendor('mac')} AS vendor, packet_count, sent_packets,
    received_packets, {_clock('ts1')} AS first_seen, {_clock('ts2')} AS last_seen,
    CASE WHEN packet_count >= 1000 THEN 'Yüksek' WHEN packet_count >= 250 THEN 'Orta'
         ELSE 'Düşük' END AS activity_level, first_order
  FROM raw_clients LEFT JOIN oui ON oui = upper(substr(mac, 1, 8))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, bssid
                               ORDER BY packet_count DESC, first_order) AS rank
  FROM clients),
ssids AS (
  SELECT DISTINCT capture_id, bssid, {_decoded('ssid')} AS ssid FROM named WHERE ssid <> ''),
channels AS (
  SELECT capture_id, bssid, channel, count(*) AS packet_count, min(seq) AS first_seq
  FROM named WHERE channel <> '' GROUP BY ALL),
modes AS (
  SELECT capture_id, bssid, arg_max(channel, (packet_count, -first_seq)) AS channel,
    max(packet_count) AS packet_count
  FROM channels GROUP BY ALL),
signals AS (
  SELECT capture_id, bssid,
    CAST(format('{{:.2f}}', CAST(sum(sig) AS DOUBLE) / count(sig)) AS DOUBLE)
      AS average_signal_dbm,
    count(sig) AS samples
  FROM named WHERE sig IS NOT NULL GROUP BY ALL),
network_keys AS (
  SELECT capture_id, bssid FROM ssids UNION SELECT capture_id, bssid FROM modes
  UNION SELECT capture_id, bssid FROM signals UNION SELECT capture_id, bssid FROM clients),
networks AS (
  SELECT k.capture_id, k.bssid, coalesce(s.ssids, []) AS ssids, m.channel,
    g.average_signal_dbm, coalesce(c.n, 0) AS client_count
  FROM network_keys k
  LEFT JOIN (SELECT capture_id, bssid, list(ssid ORDER BY ssid) AS ssids FROM ssids
             GROUP BY ALL) s USING (capture_id, bssid)
  LEFT JOIN modes m USING (capture_id, bssid)
  LEFT JOIN signals g USING (capture_id, bssid)
  LEFT JOIN (SELECT capture_id, bssid, count(*) AS n FROM clients GROUP BY ALL) c
    USING (capture_id, bssid)),
totals AS (
  SELECT capture_id, count(*) AS total_packets,
    count(*) FILTER (eapol <> '') AS eapol_packet_count
  FROM norm GROUP BY ALL),
sources AS (
  SELECT capture_id, src AS mac, count(*) AS packet_count, min(seq) AS first_seq
  FROM norm WHERE {_valid('src')} GROUP BY ALL),
destinations AS (
  SELECT capture_id, dst AS mac, count(*) AS packet_count, min(seq) AS first_seq
  FROM norm WHERE {_valid('dst')} GROUP BY ALL),
subtypes AS (
  SELECT capture_id, coalesce(any_value(name), 'Subtype ' || sub) AS subtype,
    count(*) AS packet_count, min(seq) AS first_seq
  FROM norm LEFT JOIN subtype_names ON code = sub WHERE sub <> '' GROUP BY capture_id, sub),
eapol AS (
  SELECT capture_id, seq, frame_number, ts_raw AS timestamp, src AS source,
    dst AS destination, bssid, eapol AS eapol_type
  FROM norm WHERE eapol <> ''),
candidates AS (
  SELECT capture_id, bssid, client, count(*) AS eapol_packet_count,
    arg_min(timestamp, seq) AS first_seen, arg_max(timestamp, seq) AS last_seen,
    min(seq) AS first_seq,
    CASE WHEN count(*) >= 4 THEN 'strong_candidate' ELSE 'partial' END AS status
  FROM (SELECT *, CASE WHEN source <> '' AND source <> bssid THEN source
                       WHEN destination <> '' AND destination <> bssid THEN destination END
               AS client FROM eapol WHERE bssid <> '')
  WHERE client IS NOT NULL GROUP BY capture_id, bssid, client),
verdicts AS (
  SELECT n.capture_id, n.bssid,
    count(*) FILTER (status = 'strong_candidate') AS strong,
    count(*) FILTER (status = 'partial') AS partial
  FROM networks n LEFT JOIN candidates c USING (capture_id, bssid) GROUP BY ALL),
verdict_texts AS (
  SELECT *, CASE WHEN strong > 0 THEN '● Güçlü Aday (' || strong || ')'
                 WHEN partial > 0 THEN '● Kısmi (' || partial || ')'
                 ELSE '● Bulunamadı' END AS verdict FROM verdicts),
macs AS (
  SELECT capture_id, mac, any_value(vendor) AS vendor, sum(packet_count)::BIGINT AS packet_count,
    min((bssid, rank)) AS place
  FROM ranked GROUP BY ALL),
vendor_classes AS (
  SELECT capture_id, count(*) FILTER (vendor = 'Private / Randomized MAC') AS randomized,
    count(*) FILTER (vendor = 'Bilinmiyor') AS unknown_vendor
  FROM macs GROUP BY ALL),
summary AS (
  SELECT capture_id, total_packets,
    (SELECT count(*) FROM networks n WHERE n.capture_id = t.capture_id) AS network_count,
    (SELECT count(*) FROM macs m WHERE m.capture_id = t.capture_id) AS client_count,
    eapol_packet_count
  FROM totals t),
table_view AS (
  SELECT capture_id, bssid, ssids, channel, average_signal_dbm AS dbm, client_count,
    array_to_string(ssids, ', ') AS joined,
    CASE WHEN len(ssids) > 0 THEN array_to_string(ssids, ', ') ELSE '<Gizli SSID>' END
      AS ssid_text,
    coalesce(channel, '—') AS channel_text,
    coalesce(average_signal_dbm::VARCHAR || ' dBm', '—') AS signal_text
  FROM networks)
"""

_CLIENT_COLUMNS = (
    "capture_id, bssid, mac, vendor, packet_count, sent_packets, received_packets, "
    "first_seen, last_seen, activity_level"
)


def _top(table: str, k: int) -> str:
    return f"""
SELECT capture_id, rank::INT AS rank, mac, packet_count FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id
                               ORDER BY packet_count DESC, first_seq) AS rank FROM {table})
WHERE rank <= {k}"""


def _busy(threshold: int) -> str:
    return f"""(
  SELECT capture_id, count(*) AS busy_clients,
    arg_min(mac, (-packet_count, bssid, rank)) AS busiest_mac,
    max(packet_count) AS busiest_packets
  FROM ranked WHERE packet_count >= {threshold} GROUP BY ALL)"""


def _findings(threshold: int) -> str:
    """Findings as one SELECT per rule."""

    def rule(number: int, finding: tuple, condition: str, n: str, *more: str) -> str:
        severity, category, title, description = finding
        args = [n, *more][: description.count("%")]
        from_text = f"{threshold:,}".replace(",", ".")
        template = description.replace("{busy_from}", from_text)
        template = template.replace("%d", "{}").replace("%s", "{}")
        shown = f"format('{template}', {', '.join(args)})" if args else f"'{description}'"
        return (
            f"SELECT capture_id, {number} AS rule_no, '{severity}' AS severity, "
            f"'{category}' AS category, '{title}' AS title, {shown} AS description, "
            f"{n}::BIGINT AS n FROM facts WHERE {condition}"
        )

    rules = [
        rule(1, L.FINDING_STRONG, "strong > 0", "strong"),
        rule(1, L.FINDING_PARTIAL, "strong = 0 AND partial > 0", "partial"),
        rule(1, L.FINDING_NO_HANDSHAKE, "strong = 0 AND partial = 0", "0"),
        rule(2, L.FINDING_RANDOMIZED, "randomized > 0", "randomized"),
        rule(3, L.FINDING_NO_SSID, "hidden > 0", "hidden"),
        rule(4, L.FINDING_WEAK, "weak > 0", "weak"),
        rule(
            5, L.FINDING_BUSY, "busy_clients > 0", "busy_clients", "busiest_mac", "busiest_packets"
        ),
        rule(6, L.FINDING_UNKNOWN_VENDOR, "unknown_vendor > 0", "unknown_vendor"),
    ]
    return f"""facts AS (
  SELECT t.capture_id,
    (SELECT count(*) FROM candidates c
     WHERE c.capture_id = t.capture_id AND status = 'strong_candidate') AS strong,
    (SELECT count(*) FROM candidates c
     WHERE c.capture_id = t.capture_id AND status = 'partial') AS partial,
    (SELECT count(*) FROM networks n
     WHERE n.capture_id = t.capture_id AND len(ssids) = 0) AS hidden,
    (SELECT count(*) FROM networks n
     WHERE n.capture_id = t.capture_id AND average_signal_dbm <= -80) AS weak,
    coalesce(randomized, 0) AS randomized, coalesce(unknown_vendor, 0) AS unknown_vendor,
    coalesce(busy_clients, 0) AS busy_clients, busiest_mac, busiest_packets
  FROM totals t LEFT JOIN vendor_classes v USING (capture_id)
  LEFT JOIN {_busy(threshold)} b USING (capture_id)),
findings AS ({' UNION ALL '.join(rules)})
"""


_SEVERITIES = ", ".join(
    f"({i}, '{code}', '{label}')" for i, (code, label) in enumerate(L.SEVERITY_LABELS, 1)
)

_SHOWN_CLIENTS = "mac, vendor, packet_count, sent_packets, received_packets, first_seen, " + (
    "last_seen, activity_level"
)


def _with_clients(k: int, columns: str) -> str:
    return f"""
SELECT v.capture_id, v.bssid, {{texts}}, client_count, rank::INT AS rank, {columns},
  greatest(client_count - {k}, 0) AS remaining{{more}}
FROM table_view v LEFT JOIN (SELECT * FROM ranked WHERE rank <= {k}) r
  USING (capture_id, bssid)"""


def _texts(value: str) -> str:
    return (
        "len(ssids) AS ssid_count, "
        f"coalesce(channel, '{value}') AS channel_text, "
        f"coalesce(dbm::VARCHAR || ' dBm', '{value}') AS signal_text"
    )


def _named(ssid: str) -> str:
    """One row per network and name, with a text for one without any."""
    return (
        "(SELECT t.* EXCLUDE (ssid_text), coalesce(s.ssid, '" + ssid + "') AS ssid_text "
        "FROM table_view t LEFT JOIN ssids s USING (capture_id, bssid))"
    )


_CLIENT_CSV = """
SELECT capture_id, bssid AS "BSSID", coalesce(ssid, '') AS "SSID", mac AS "Istemci_MAC",
  packet_count AS "Paket_Sayisi\""""
_CLIENT_CSV_FROM = "FROM clients LEFT JOIN ssids USING (capture_id, bssid)"


def _resolved() -> str:
    """The field that supplies each logical column in the three kinds of exports."""
    rows = []
    for pos, (name, fields) in enumerate(FIELD_CANDIDATES.items(), 1):
        third = "NULL" if name == "frame_type" else f"'{fields[0]}'"
        for site, field in enumerate((f"'{fields[0]}'", f"'{fields[-1]}'", third)):
            rows.append(f"({site}, {pos}, '{name}', {field})")
    return ", ".join(rows)


_RAGGED = """
SELECT * EXCLUDE (capture_id, cut) REPLACE (
  CASE WHEN cut THEN '' ELSE bssid END AS bssid, CASE WHEN cut THEN false ELSE bssid_ok END AS bssid_ok,
  CASE WHEN cut THEN '' ELSE ssid END AS ssid, CASE WHEN cut THEN '' ELSE channel END AS channel,
  CASE WHEN NOT cut THEN sig END AS sig, CASE WHEN cut THEN '' ELSE eapol END AS eapol)
FROM (SELECT *, frame_number::BIGINT % 5 = 0 AS cut FROM norm)"""


def oracle_sql(frames: str = _FRAMES) -> dict[str, str]:
    """SQL per query; `frames` is the SELECT that gives the raw frames."""
    network_columns = (
        "capture_id, bssid, channel, dbm AS average_signal_dbm, client_count, "
        "len(ssids) AS ssid_count"
    )
    default_findings = _findings(L.BUSY_CLIENT_FROM)
    no_clients = f"WHEN client_count = 0 THEN '{L.NO_CLIENTS_NOTE}'"
    more_clients = L.MORE_CLIENTS_NOTE.replace("%d", "{}")
    note = (
        f", CASE {no_clients} WHEN client_count > 25 "
        f"THEN format('{more_clients}', client_count) ELSE '' END AS note"
    )
    bodies = {
        "frames_normalized": "SELECT * FROM norm",
        "frame_store": "SELECT * FROM norm",
        "tsv_scan": "SELECT * EXCLUDE (capture_id) FROM norm",
        "frame_checks": "SELECT capture_id, seq, "
        + ", ".join(
            f"{_valid(c)}::INT AS {c}_valid, {_ignored(c)}::INT AS {c}_ignored"
            for c in ("src", "dst", "bssid")
        )
        + " FROM norm",
        "ssid_decode": f"""
SELECT ssid, count(*) AS packet_count, {_decoded('ssid')} AS decoded FROM norm GROUP BY ssid""",
        "vendor_lookup": f"""
SELECT mac, {_oui('mac')} AS oui, {_local('mac')}::INT AS local, {_vendor('mac')} AS vendor
FROM (SELECT src AS mac FROM norm UNION SELECT dst FROM norm)
LEFT JOIN (SELECT oui AS o, vendor FROM oui) ON o = {_oui('mac')}""",
        "link_rollup": """
SELECT capture_id, CASE WHEN bssid_ok THEN bssid ELSE '' END AS bssid,
  CASE WHEN src_ok THEN src ELSE '' END AS src, CASE WHEN dst_ok THEN dst ELSE '' END AS dst,
  count(*) AS n, min(seq) AS first_seq,
  min(seq) FILTER (ts IS NOT NULL) AS first_ts_seq,
  arg_min(ts, seq) FILTER (ts IS NOT NULL) AS first_ts,
  max(seq) FILTER (ts IS NOT NULL) AS last_ts_seq,
  arg_max(ts, seq) FILTER (ts IS NOT NULL) AS last_ts
FROM norm GROUP BY ALL""",
        "radio_rollup": """
SELECT capture_id, CASE WHEN bssid_ok THEN bssid ELSE '' END AS bssid, channel, ssid, sub,
  count(*) AS n, min(seq) AS first_seq,
  coalesce(sum(sig), 0)::BIGINT AS sig_sum, count(sig) AS sig_n,
  count(*) FILTER (eapol <> '') AS eapol_n
FROM norm GROUP BY ALL""",
        "networks_from_rollups": f"SELECT {network_columns} FROM table_view",
        "clients_from_rollups": "SELECT * FROM clients",
        "findings_from_rollups": (default_findings, "SELECT * FROM findings"),
        "summary_from_rollups": "SELECT * FROM summary",
        "packet_totals": "SELECT * FROM totals",
        "source_counts": "SELECT * FROM sources",
        "destination_counts": "SELECT * FROM destinations",
        "subtype_distribution": "SELECT * FROM subtypes",
        "subtype_decimal": """
SELECT capture_id, coalesce(any_value(name), 'Subtype ' || c) AS subtype,
  count(*) AS packet_count, min(seq) AS first_seq
FROM (SELECT *, CASE WHEN sub LIKE '0x%' THEN CAST(CAST(sub AS INT) AS VARCHAR)
                     ELSE sub END AS c FROM norm WHERE sub <> '')
LEFT JOIN subtype_names ON code = c GROUP BY capture_id, c""",
        "top_sources": _top("sources", 20),
        "top_destinations": _top("destinations", 20),
        "top_sources_cli": _top("sources", 10),
        "networks": f"SELECT {network_columns} FROM table_view",
        "network_ssids": "SELECT * FROM ssids",
        "network_channel_counts": "SELECT * FROM channels",
        "network_channel_mode": "SELECT * FROM modes",
        "network_signal": "SELECT * FROM signals",
        "network_measures": """
SELECT capture_id, bssid, channel, average_signal_dbm, client_count,
  len(ssids) AS ssid_count FROM networks""",
        "network_search": f"""
SELECT {network_columns} FROM table_view
WHERE len(list_filter(ssids, lambda x: contains(lower(x), 'ap-1'))) > 0
  OR contains(lower(bssid), 'ap-1')""",
        "network_search_comma": f"""
SELECT {network_columns} FROM table_view
WHERE contains(lower(array_to_string(ssids, ', ')), 'net0, net1, net2')""",
        "network_search_part": f"""
SELECT {network_columns} FROM table_view
WHERE contains(lower(array_to_string(ssids, ', ')), '1, n')""",
        "clients_in_batches": "SELECT * FROM clients",
        "networks_in_batches": f"SELECT {network_columns} FROM table_view",
        "findings_in_batches": (default_findings, "SELECT * FROM findings"),
        "summary_in_batches": "SELECT * FROM summary",
        "mac_set_counts": """
SELECT captures, count(DISTINCT mac) AS client_count,
  count(DISTINCT mac) FILTER (vendor = 'Private / Randomized MAC') AS randomized,
  count(DISTINCT mac) FILTER (vendor = 'Bilinmiyor') AS unknown_vendor
FROM (SELECT mac, vendor, unnest([capture_id, 'all',
        CASE WHEN capture_id < 'cap2' THEN 'first' ELSE 'last' END]) AS captures FROM clients)
GROUP BY captures""",
        "network_search_hidden": f"SELECT {network_columns} FROM table_view WHERE len(ssids) = 0",
        "network_search_blank": f"SELECT {network_columns} FROM table_view",
        "client_endpoints": """
SELECT capture_id, bssid, mac, 2 * seq + side AS first_order,
  (mac = src)::BIGINT AS sent, (mac = dst)::BIGINT AS received FROM ends""",
        "clients": "SELECT * FROM clients",
        "client_ranks": "SELECT capture_id, bssid, mac, packet_count, rank FROM ranked",
        "clients_top25": """
SELECT * EXCLUDE (rank), rank::INT AS rank FROM ranked WHERE rank <= 25""",
        "client_activity_total": "SELECT capture_id, mac, packet_count FROM macs",
        "distinct_clients": "SELECT capture_id, count(*) AS client_count FROM macs GROUP BY ALL",
        "client_class_counts": f"""
SELECT v.*, coalesce(busy_clients, 0) AS busy_clients, busiest_mac, busiest_packets
FROM vendor_classes v LEFT JOIN {_busy(BUSY_FROM)} b USING (capture_id)""",
        "client_search": f"""
SELECT {_CLIENT_COLUMNS} FROM clients
WHERE contains(lower(mac), 'apple') OR contains(lower(vendor), 'apple')""",
        "client_search_mac": f"""
SELECT {_CLIENT_COLUMNS} FROM clients
WHERE contains(lower(mac), '02:11:22') OR contains(lower(vendor), '02:11:22')""",
        "client_details": f"SELECT {_CLIENT_COLUMNS} FROM clients",
        "eapol_packets": "SELECT * FROM eapol",
        "first_eapol_packets": """
SELECT * EXCLUDE (rank, total), rank::INT AS rank, greatest(total - 50, 0) AS remaining
FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY seq) AS rank,
        count(*) OVER (PARTITION BY capture_id) AS total FROM eapol)
WHERE rank <= 50""",
        "handshake_candidates": "SELECT * FROM candidates",
        "strong_handshakes": "SELECT * FROM candidates WHERE status = 'strong_candidate'",
        "partial_handshakes": "SELECT * FROM candidates WHERE status = 'partial'",
        "handshake_details": """
SELECT capture_id, bssid, client, eapol_packet_count,
  CASE status WHEN 'strong_candidate' THEN 'Güçlü Aday' ELSE 'Kısmi' END AS status_text,
  first_seen, last_seen
FROM candidates""",
        "network_handshake_verdict": "SELECT * FROM verdict_texts",
        "findings": (default_findings, "SELECT * FROM findings"),
        "findings_busy": (_findings(BUSY_FROM), "SELECT * FROM findings"),
        "finding_severity_counts": (
            default_findings,
            f"""
SELECT capture_id, position, severity, severity_label,
  (SELECT count(*) FROM findings f
   WHERE f.capture_id = t.capture_id AND f.severity = s.severity) AS finding_count,
  (SELECT count(*) FROM findings f WHERE f.capture_id = t.capture_id) AS total
FROM totals t, (VALUES {_SEVERITIES}) s(position, severity, severity_label)""",
        ),
        "report_findings": (
            default_findings,
            f"""
SELECT capture_id, rule_no, severity_label, upper(category) AS category_label, title,
  description
FROM findings JOIN (VALUES {_SEVERITIES}) s(position, severity, severity_label)
  USING (severity)""",
        ),
        "capture_summary": """
SELECT *, format('{:,}', total_packets) AS total_packets_text FROM summary""",
        "signal_chart": """
SELECT capture_id, rank::INT AS rank, bssid,
  unnest(CASE WHEN len(ssids) > 0 THEN ssids ELSE [bssid] END) AS label, dbm AS average_signal_dbm,
  format('{:.1f} dBm', dbm) AS value_text,
  CAST(trunc(least(greatest((dbm + 100) / 70 * 100, 0), 100)) AS INT) AS progress
FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY dbm DESC, bssid) AS rank
      FROM table_view WHERE dbm IS NOT NULL)
WHERE rank <= 10""",
        "subtype_chart": """
SELECT capture_id, rank::INT AS rank, subtype, packet_count,
  format('{:,}', packet_count) AS value_text,
  CAST(trunc(packet_count / max(packet_count) OVER (PARTITION BY capture_id) * 100) AS INT)
    AS progress
FROM (SELECT *, row_number() OVER (PARTITION BY capture_id
                                   ORDER BY packet_count DESC, first_seq) AS rank
      FROM subtypes) WHERE rank <= 10""",
        "active_client_chart": """
SELECT capture_id, rank::INT AS rank, mac, packet_count,
  format('{:,}', packet_count) AS value_text,
  CAST(trunc(packet_count / max(packet_count) OVER (PARTITION BY capture_id) * 100) AS INT)
    AS progress
FROM (SELECT *, row_number() OVER (PARTITION BY capture_id
                                   ORDER BY packet_count DESC, place) AS rank
      FROM macs) WHERE rank <= 10""",
        "network_table": f"""
SELECT capture_id, bssid, ssid_text, channel_text, signal_text, client_count
FROM {_named('<Gizli SSID>')}""",
        "summary_network_names": f"""
SELECT capture_id, bssid, ssid_text, coalesce(channel, 'bilinmiyor') AS channel_text,
  coalesce(dbm::VARCHAR || ' dBm', 'bilinmiyor') AS signal_text, client_count
FROM {_named('<SSID belirlenemedi veya gizli>')}""",
        "network_details": f"""
SELECT capture_id, v.bssid, ssid_text, channel_text, signal_text, client_count,
  eapol_packet_count, verdict
FROM {_named('<Gizli SSID>')} v JOIN verdict_texts USING (capture_id, bssid)
  JOIN totals USING (capture_id)""",
        "network_details_selected": f"""
SELECT capture_id, v.bssid, ssid_text, channel_text, signal_text, client_count,
  eapol_packet_count, verdict
FROM {_named('<Gizli SSID>')} v JOIN verdict_texts USING (capture_id, bssid)
  JOIN totals USING (capture_id)
WHERE v.bssid = '3c:a7:ae:00:00:01'""",
        "report_networks": _with_clients(25, _SHOWN_CLIENTS).format(
            texts=_texts("Bilinmiyor"), more=note
        ),
        "report_subtypes": "SELECT capture_id, subtype, packet_count FROM subtypes",
        "summary_networks": _with_clients(10, "mac, packet_count").format(
            texts=_texts("bilinmiyor"), more=""
        ),
        "networks_csv_files": f"""
SELECT capture_id, ssid_text AS "SSID", bssid AS "BSSID", channel AS "Kanal",
  dbm AS "Ortalama_Sinyal_dBm", client_count AS "Istemci_Sayisi" FROM {_named('')}""",
        "networks_csv": f"""
SELECT capture_id, ssid_text AS "SSID", bssid AS "BSSID", channel AS "Kanal",
  dbm AS "Ortalama_Sinyal_dBm", client_count AS "Istemci_Sayisi" FROM {_named('')}""",
        "clients_csv": f"{_CLIENT_CSV}, first_order {_CLIENT_CSV_FROM}",
        "clients_csv_files": f"{_CLIENT_CSV} {_CLIENT_CSV_FROM}",
        "report_files": (default_findings, """
SELECT '_1' AS writer, section, rows FROM (
  SELECT 'json/captures' AS section, count(*) AS rows FROM totals
  UNION ALL SELECT 'json/envelope', count(*) FROM totals
  UNION ALL SELECT 'json/capture_summary', count(*) FROM totals
  UNION ALL SELECT 'json/networks', count(*) FROM networks
  UNION ALL SELECT 'json/network_ssids', count(*) FROM ssids
  UNION ALL SELECT 'json/clients', count(*) FROM clients
  UNION ALL SELECT 'json/frame_subtypes', count(*) FROM subtypes
  UNION ALL SELECT 'json/top_sources', sum(least(n, 20)) FROM
    (SELECT count(*) AS n FROM sources GROUP BY capture_id)
  UNION ALL SELECT 'json/top_destinations', sum(least(n, 20)) FROM
    (SELECT count(*) AS n FROM destinations GROUP BY capture_id)
  UNION ALL SELECT 'json/eapol_packets', count(*) FROM eapol
  UNION ALL SELECT 'json/handshake_candidates', count(*) FROM candidates
  UNION ALL SELECT 'json/findings', count(*) FROM findings
  UNION ALL SELECT 'networks_csv', sum(greatest(len(ssids), 1)) FROM networks
  UNION ALL SELECT 'clients_csv', sum(greatest(len(ssids), 1))
    FROM clients JOIN networks USING (capture_id, bssid))"""),
        "store_by_key": """
SELECT * EXCLUDE (capture_id), capture_id AS capture_name FROM clients
WHERE capture_id IN ('cap0', 'cap2')""",
        "handshake_details_selected": """
SELECT capture_id, bssid, client, eapol_packet_count,
  CASE status WHEN 'strong_candidate' THEN 'Güçlü Aday' ELSE 'Kısmi' END AS status_text,
  first_seen, last_seen
FROM candidates WHERE lower(bssid) = '3c:a7:ae:00:00:01' AND capture_id = 'cap1'""",
        "client_details_selected": f"""
SELECT {_CLIENT_COLUMNS} FROM clients
WHERE bssid = '3c:a7:ae:00:00:01' AND capture_id = 'cap1'""",
        "findings_default_busy": (default_findings, "SELECT * FROM findings"),
        "json_ssids": "SELECT * FROM ssids",
        "json_sources": _top("sources", 20),
        "json_destinations": _top("destinations", 20),
        "json_eapol": "SELECT * FROM eapol",
        "json_findings": (default_findings, "SELECT * FROM findings"),
        "json_summary": "SELECT * FROM summary",
        "csv_blanks": "SELECT capture_id, bssid, ' ' || ssid || ' ' AS ssid FROM ssids",
        "captures_by_path": """
SELECT (frame_number::BIGINT % 3)::INT AS site, count(*) AS packet_count FROM norm GROUP BY ALL""",
        "mixed_captures": "SELECT * EXCLUDE (capture_id) FROM norm",
        "mixed_fields": f"""
SELECT site, pos::INT AS pos, logical_name, physical_name, physical_name IS NOT NULL AS available
FROM (VALUES {_resolved()}) t(site, pos, logical_name, physical_name)
WHERE site IN (SELECT frame_number::BIGINT % 3 FROM norm)""",
        "ragged_exports": _RAGGED,
        "damaged_exports": """
SELECT i::INT AS site, count(n) AS rows,
  count(n) FILTER ((i = 3 AND n % 10 = 1) OR (i IN (1, 2) AND n > total - 4)) AS odd_rows,
  CASE WHEN count(n) = 0 THEN 'failed' WHEN i IN (1, 2) THEN 'truncated'
    WHEN i = 3 AND count(n) FILTER (n % 10 = 1 AND n <= total - 4) > 0 THEN 'check'
    ELSE 'ok' END AS status,
  CASE i WHEN 1 THEN 'open quote in the last row' WHEN 2 THEN 'short last row' END AS reason
FROM range(5) r(i) LEFT JOIN (SELECT frame_number::BIGINT AS n FROM norm) ON i = n % 4
  CROSS JOIN (SELECT count(*) AS total FROM norm)
GROUP BY i""",
        "admitted_files": """
SELECT (frame_number::BIGINT % 3)::INT AS site, count(*) AS packet_count FROM norm
WHERE frame_number::BIGINT % 3 <> 1 GROUP BY ALL""",
        "client_activity_busy": "SELECT * FROM clients",
        "json_networks": f"SELECT {network_columns} FROM table_view",
        "json_clients": "SELECT * FROM clients",
        "json_subtypes": "SELECT * FROM subtypes",
        "json_handshakes": "SELECT * FROM candidates",
        "report_envelope": """
SELECT capture_id, 'airsift' AS product, 'Wi-Fi Forensics' AS module,
  '2024-01-01T00:00:00' AS generated_at, total_packets, network_count,
  client_count, eapol_packet_count FROM summary""",
    }
    sql = {}
    told = "CASE WHEN try_cast(frame_number AS BIGINT) % 10 = 0 THEN 1000 ELSE 1 END"
    repeated = f"SELECT f.* FROM ({frames}) f, unnest(range({told})) u(x)"
    for name, body in bodies.items():
        extra, select = body if isinstance(body, tuple) else ("", body)
        busy = name in ("client_activity_busy", "findings_default_busy")
        source = repeated if busy else frames
        sql[name] = COMMON.replace(":frames", source) + (f", {extra}" if extra else "") + select
    return sql
