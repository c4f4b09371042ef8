"""Registry of queries and the SQL tables their checks start from."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    """Register a ``(spark, folder) -> DataFrame`` function under ``name``."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = (BASE_SQL + sql) if base else sql
        return fn
    return register


BASE_SQL = """
WITH ev AS (
  SELECT event_id, user_id, CAST(user_id AS VARCHAR) AS sn, event_type, value, ts,
         CAST(floor(epoch(ts)) AS BIGINT) AS time_ts,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 10 AS k
  FROM events),
plain_logs AS (
  SELECT event_id AS row_id, sn, ts AS time, time_ts, 'sm' || (user_id % 12) AS server_model,
         event_type || ' | k ' || k || ' | ' ||
         CASE WHEN value < 20 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END AS msg_lower
  FROM ev),
msg_ids AS (
  SELECT msg_lower, min(row_id) AS first_row, row_number() OVER (ORDER BY min(row_id)) - 1 AS msg_id
  FROM plain_logs GROUP BY msg_lower),
masked AS (
  SELECT msg_lower, first_row, regexp_replace(msg_lower, ' k [0-9]+ ', ' k <:NUM:> ') AS template FROM msg_ids),
tpl_ids AS (
  SELECT template, row_number() OVER (ORDER BY min(first_row)) AS tpl FROM masked GROUP BY template),
logs AS (
  SELECT l.*, i.msg_id, t.tpl, CAST(t.tpl AS VARCHAR) AS template_id, t.template
  FROM plain_logs l JOIN msg_ids i USING (msg_lower) JOIN masked m USING (msg_lower) JOIN tpl_ids t USING (template)),
faults AS (
  SELECT event_id AS fault_id, sn, ts AS fault_time, time_ts AS fault_ts, CAST(event_id % 4 AS INTEGER) AS label,
         'sm' || (user_id % 12) AS own_model
  FROM ev WHERE event_type = 'error'),
submit AS (
  SELECT event_id AS fault_id, sn, ts AS fault_time, time_ts AS fault_ts FROM ev WHERE event_type = 'purchase'),
crash AS (SELECT sn, time_ts, event_id AS row_id FROM ev WHERE event_type = 'signup'),
venus AS (
  SELECT sn, ts AS time, time_ts, event_id AS row_id, repeat('m,', CAST(event_id % 3 AS INTEGER)) || 'm' AS module
  FROM ev WHERE event_type = 'view'),
prior AS (
  SELECT f.fault_id, f.label, f.fault_ts, l.*,
         row_number() OVER (PARTITION BY f.fault_id ORDER BY l.time DESC, l.row_id DESC) AS back,
         count(*) OVER (PARTITION BY f.fault_id) AS pos
  FROM faults f JOIN logs l ON l.sn = f.sn AND l.time_ts <= f.fault_ts),
t50 AS (SELECT * FROM prior WHERE back <= 50),
t20 AS (SELECT * FROM prior WHERE back <= 20),
gaps AS (
  SELECT * FROM (
    SELECT fault_id, back, time_ts - lag(time_ts) OVER (PARTITION BY fault_id ORDER BY time, row_id) AS gap FROM t20)
  WHERE gap IS NOT NULL)
"""
