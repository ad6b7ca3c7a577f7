"""Frames derived from an `events` table, for tests and benchmarks.

Every event becomes one frame by fixed rules, so all analyses run over the whole
table and their work grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"

FRAMES_FROM_EVENTS = """
SELECT concat('cap', CAST(m AS STRING)) AS capture_id,
 CAST(event_id + 1 AS STRING) AS frame_number,
 CASE WHEN event_id % 101 = 0 THEN ''
      ELSE CAST(CAST(FLOOR({us} / 1000000) AS BIGINT) AS STRING) END AS timestamp,
 CASE event_type WHEN 'purchase' THEN '2' ELSE '0' END AS frame_type,
 CASE event_type WHEN 'view' THEN '8' WHEN 'click' THEN '4' WHEN 'signup' THEN '11'
      WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '12' ELSE '0x000c' END
      ELSE '32' END AS frame_subtype,
 CASE WHEN event_id % 4 IN (0, 3) THEN cl WHEN event_id % 11 = 1 THEN upper(ap)
      ELSE ap END AS source,
 CASE event_id % 4 WHEN 0 THEN ap WHEN 1 THEN cl WHEN 2 THEN 'ff:ff:ff:ff:ff:ff'
      ELSE CASE event_id % 3 WHEN 0 THEN '01:00:5e:00:00:fb' WHEN 1 THEN '33:33:00:00:00:01'
           ELSE cl END END AS destination,
 CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 89 = 0 THEN 'not-a-mac'
      WHEN event_id % 13 = 0 THEN upper(ap)
      WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'ff:ff:ff:ff:ff:ff'
      ELSE ap END AS bssid,
 CASE WHEN event_type <> 'view' OR user_id % 12 = 3 THEN ''
      WHEN user_id % 12 = 4 THEN '4c61624e6574' WHEN user_id % 12 = 5 THEN 'cafe'
      WHEN user_id % 12 = 6 THEN concat('Net', CAST(event_id % 3 AS STRING), ',x')
      ELSE concat('AP-', CAST(user_id % 12 AS STRING)) END AS ssid,
 CASE WHEN event_id % 17 = 0 THEN ''
      ELSE CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '6' ELSE '11' END END AS channel,
 CASE WHEN event_id % 19 = 0 THEN '' WHEN event_id % 23 = 0 THEN 'n/a'
      WHEN event_id % 7 = 0
        THEN concat('-', CAST(30 + user_id % 12 * 5 + event_id % 9 AS STRING), '.9,-1')
      ELSE concat('-', CAST(30 + user_id % 12 * 5 + event_id % 9 AS STRING)) END AS signal,
 CASE WHEN event_type = 'signup' AND event_id % 7 = 0 THEN '3' ELSE '' END AS eapol_type
FROM (SELECT *, CAST(FLOOR(event_id / 7) AS BIGINT) % 3 AS m,
  concat('3c:a7:ae:00:00:', lpad(lower(hex(user_id % 12)), 2, '0')) AS ap,
  concat(CASE user_id % 5 WHEN 0 THEN '00:1b:63' WHEN 1 THEN '02:11:22' WHEN 2 THEN 'aa:bb:cc'
              WHEN 3 THEN '00:1a:79' ELSE '00:50:56' END,
         ':00:', substr(lpad(lower(hex(user_id)), 4, '0'), 1, 2),
         ':', substr(lpad(lower(hex(user_id)), 4, '0'), 3, 2)) AS cl
  FROM {events}) t
"""


EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING"


def frames_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    query = FRAMES_FROM_EVENTS.replace("{us}", _MICROS)
    return spark.sql(query, events=events)
