"""Independent SQL (DuckDB dialect) for every registered query.

Each oracle re-derives its inputs from the ``events`` view in CTEs, written
the straightforward way (ticks joined to the records they see, ``ASOF JOIN``
for as-of lookups, closed-form sums for the meters) so that it does not share
the engine's strategy.  Times are exposed as epoch seconds, doubles rounded
to 6 places, and ``+ 0.0`` folds -0.0 into 0.0.
"""

from __future__ import annotations

from lagscope import schemas as S
from lagscope.sources.fixtures import INTERVALS, PRODUCE_PHASE_SECONDS, RETENTION_SECONDS


def base_ctes(grid: str) -> str:
    """rec, ticks, tp (topic_partitions), listings, descr, assigned, commits,
    committed, lags."""
    iv = INTERVALS[grid]
    return f"""
rec AS (
  SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition,
         epoch_us(ts) AS us, event_id, 'g' || (user_id // 4 % 5) AS group_id
  FROM events),
ends AS (SELECT min(us) // {iv}000000 * {iv} AS t0, max(us) AS hi FROM rec),
ticks AS (
  SELECT CAST(k AS BIGINT) AS k, CAST(t0 + k * {iv} AS BIGINT) AS ts
  FROM (SELECT t0, unnest(range(1, greatest(1, (hi - t0 * 1000000 + {iv}000000 - 1) // {iv}000000) + 1)) AS k
        FROM ends)),
tp0 AS (
  SELECT t.k, t.ts, r.topic, r.partition,
         CAST(count(*) AS BIGINT) AS newest_offset,
         CAST(count(*) FILTER (WHERE r.us <= (t.ts - {RETENTION_SECONDS}) * 1000000) AS BIGINT)
           AS oldest_offset
  FROM ticks t JOIN rec r ON r.us <= t.ts * 1000000
  GROUP BY t.k, t.ts, r.topic, r.partition),
tp1 AS (
  SELECT *, [CAST(1 + partition % 3 AS INTEGER), CAST(1 + (partition + 1) % 3 AS INTEGER)] AS replicas
  FROM tp0),
tp AS (
  SELECT k, ts, topic, partition, oldest_offset, newest_offset, replicas,
         CASE WHEN (k + partition) % 7 = 0 THEN [replicas[1]] ELSE replicas END AS isr,
         CASE WHEN (k + partition) % 13 = 0 THEN NULL
              WHEN (k + partition) % 11 = 0 THEN replicas[2]
              ELSE replicas[1] END AS leader_id
  FROM tp1),
seen AS (
  SELECT DISTINCT r.group_id, r.topic, r.partition,
         greatest(1, (r.us - e.t0 * 1000000 + {iv}000000 - 1) // {iv}000000) AS k
  FROM rec r, ends e),
listings AS (
  SELECT DISTINCT t.ts, 1 + s.partition % 3 AS broker_id, s.group_id,
         CASE WHEN s.group_id = 'g4' THEN 'connect' ELSE 'consumer' END AS protocol_type
  FROM seen s JOIN ticks t ON t.k = s.k),
since AS (SELECT group_id, topic, partition, min(k) AS k FROM seen GROUP BY ALL),
listed AS (SELECT DISTINCT ts, group_id FROM listings),
assign_at AS (
  SELECT t.k, l.ts, l.group_id, s.topic, s.partition, s.k = t.k AS new
  FROM listed l JOIN ticks t ON t.ts = l.ts JOIN since s ON s.group_id = l.group_id AND s.k <= t.k),
described AS (
  SELECT ts, group_id, CASE WHEN group_id = 'g4' THEN 'connect' ELSE 'consumer' END AS protocol_type,
         CASE WHEN bool_or(new) THEN 'PreparingRebalance' ELSE 'Stable' END AS state,
         CAST(count(DISTINCT partition) AS INTEGER) AS n_members
  FROM assign_at GROUP BY ts, group_id),
stable AS (SELECT * FROM described WHERE state = 'Stable' AND protocol_type = 'consumer'),
assigned AS (
  SELECT a.ts, a.group_id, a.topic, a.partition
  FROM assign_at a JOIN stable s ON s.ts = a.ts AND s.group_id = a.group_id),
commits AS (
  SELECT a.ts AS commit_ts, a.group_id, a.topic, a.partition, tp.newest_offset AS "offset"
  FROM assign_at a
  JOIN tp ON tp.topic = a.topic AND tp.partition = a.partition
         AND tp.k = a.k - CAST(substr(a.group_id, 2) AS BIGINT)),
committed AS (
  SELECT a.ts, a.group_id, a.topic, a.partition, coalesce(c."offset", -1) AS committed
  FROM assigned a ASOF LEFT JOIN commits c
    ON a.group_id = c.group_id AND a.topic = c.topic AND a.partition = c.partition
   AND a.ts >= c.commit_ts),
lags AS (
  SELECT c.ts, c.group_id, c.topic, c.partition, c.committed,
         coalesce(tp.newest_offset, 0) - c.committed AS lag
  FROM committed c LEFT JOIN tp
    ON tp.ts = c.ts AND tp.topic = c.topic AND tp.partition = c.partition)"""


def gauge_ctes() -> str:
    """g_part (seven partition gauges), g_topic, g_group, gauges (all ten)."""
    return f"""
g_part AS (
  SELECT name, topic || '-' || partition AS key, NULL::VARCHAR AS group_id, topic,
         partition, ts, value
  FROM (
    SELECT ts, topic, partition, '{S.OFFSET_NEWEST}' AS name, newest_offset AS value FROM tp
    UNION ALL SELECT ts, topic, partition, '{S.OFFSET_OLDEST}', oldest_offset FROM tp
    UNION ALL SELECT ts, topic, partition, '{S.LEADER}', CAST(leader_id AS BIGINT)
      FROM tp WHERE leader_id IS NOT NULL
    UNION ALL SELECT ts, topic, partition, '{S.REPLICAS}', CAST(len(replicas) AS BIGINT) FROM tp
    UNION ALL SELECT ts, topic, partition, '{S.IN_SYNC_REPLICAS}', CAST(len(isr) AS BIGINT) FROM tp
    UNION ALL SELECT ts, topic, partition, '{S.LEADER_IS_PREFERRED}',
      CAST(CASE WHEN leader_id IS NOT NULL AND len(replicas) > 0 AND replicas[1] = leader_id
           THEN 1 ELSE 0 END AS BIGINT) FROM tp
    UNION ALL SELECT ts, topic, partition, '{S.UNDER_REPLICATED}',
      CAST(CASE WHEN len(isr) < len(replicas) THEN 1 ELSE 0 END AS BIGINT) FROM tp) x),
g_topic AS (
  SELECT '{S.TOPIC_PARTITION}' AS name, topic AS key, NULL::VARCHAR AS group_id, topic,
         NULL::INTEGER AS partition, ts, CAST(count(*) AS BIGINT) AS value
  FROM tp GROUP BY ts, topic),
g_group AS (
  SELECT '{S.GROUP_LAG}' AS name, group_id || '-' || topic || '-' || partition AS key,
         group_id, topic, partition, ts, CAST(lag AS BIGINT) AS value FROM lags
  UNION ALL
  SELECT '{S.GROUP_LATEST_OFFSET}', group_id || '-' || topic || '-' || partition,
         group_id, topic, partition, ts, CAST(committed AS BIGINT) FROM lags),
gauges AS (SELECT * FROM g_topic UNION ALL SELECT * FROM g_part UNION ALL SELECT * FROM g_group)"""


def meter_ctes() -> str:
    """Closed-form meters at produce instants: m_topic, m_group, meters."""
    def one(name, keys, src):
        kcols = ", ".join(keys)
        keyexpr = " || '-' || ".join(f"f.{k}" for k in keys)
        on = " AND ".join(f"m.{k} = f.{k}" for k in keys)
        grp = "f.group_id" if "group_id" in keys else "NULL::VARCHAR"
        fkeys = ", ".join(f"f.{k}" for k in keys)
        return f"""
{name}_sum AS ({src}),
{name}_marks AS (
  SELECT {kcols}, ts AS t, total - lag(total) OVER (PARTITION BY {kcols} ORDER BY ts) AS d
  FROM {name}_sum QUALIFY d IS NOT NULL),
{name}_first AS (
  SELECT {kcols}, min(t) AS t_first, min(t // 5 + 1) AS k_first FROM {name}_marks GROUP BY {kcols}),
{name}_at AS (
  SELECT f.*, p.T, p.T // 5 AS K
  FROM {name}_first f JOIN prod p ON p.T >= f.t_first),
{name} AS (
  SELECT {keyexpr} AS key, {grp} AS group_id, f.topic, f.T AS ts,
    CAST(sum(m.d) FILTER (WHERE m.t <= f.T) AS BIGINT) AS count,
    {', '.join(f'''round(coalesce(sum(CASE WHEN m.t // 5 + 1 = f.k_first THEN 1.0 ELSE 1 - exp(-5.0 / (60 * {N})) END
              * m.d / 5.0 * exp(-5.0 * (f.K - (m.t // 5 + 1)) / (60 * {N})))
              FILTER (WHERE m.t // 5 + 1 <= f.K), 0), 6) + 0.0 AS rate{N}''' for N in (1, 5, 15))},
    round(sum(m.d) FILTER (WHERE m.t <= f.T)
          / nullif(greatest(max(m.t) FILTER (WHERE m.t <= f.T), 5 * f.K) - f.t_first, 0), 6) + 0.0
      AS rate_mean
  FROM {name}_at f JOIN {name}_marks m ON {on}
  GROUP BY {fkeys}, f.T, f.K, f.t_first, f.k_first)"""

    topic_src = "SELECT ts, topic, CAST(sum(newest_offset) AS BIGINT) AS total FROM tp GROUP BY ts, topic"
    group_src = ("SELECT ts, group_id, topic, CAST(sum(committed) AS BIGINT) AS total "
                 "FROM committed GROUP BY ts, group_id, topic")
    return f"""
prod AS (SELECT ts + {PRODUCE_PHASE_SECONDS} AS T FROM ticks),""" + \
        one("m_topic", ["topic"], topic_src) + "," + one("m_group", ["group_id", "topic"], group_src) + f""",
meters AS (
  SELECT '{S.TOPIC_RATE}' AS name, * FROM m_topic
  UNION ALL SELECT '{S.GROUP_RATE}' AS name, * FROM m_group)"""


def snapshot_ctes() -> str:
    """g_snap: gauges carried forward to every produce instant (ASOF JOIN)."""
    return """
series AS (
  SELECT name, key, group_id, topic, partition, min(ts) AS first_ts FROM gauges GROUP BY ALL),
series_at AS (SELECT s.*, p.T FROM series s JOIN prod p ON p.T >= s.first_ts),
g_snap AS (
  SELECT s.name, s.key, s.group_id, s.topic, s.partition, s.T AS ts, o.value
  FROM series_at s ASOF JOIN gauges o
    ON s.name = o.name AND s.key = o.key AND s.T >= o.ts)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts)
