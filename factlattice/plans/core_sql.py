"""SQL that the pN_ queries of the general problems are compared with."""

_KEPT = """k AS (SELECT *, CASE WHEN id IS NOT NULL THEN 'e' || regexp_replace(lower(id), '[^0-9a-f]', '', 'g') ELSE 'm' || message_id END AS msg FROM api_usage_events),
u AS (SELECT lower(tenant_id) AS t, CAST(occurred_at AS DATE) AS d, coalesce(rows_served, 0) AS r FROM (SELECT *, row_number() OVER (PARTITION BY msg
ORDER BY delivered_at, delivery_id) AS n FROM k) x
  WHERE n = 1 AND tenant_id IS NOT NULL AND occurred_at IS NOT NULL),
s AS (SELECT t, min(d) AS f, max(d) AS l FROM u GROUP BY t),
g AS (SELECT t, f, unnest(generate_series(CAST(f AS TIMESTAMP), CAST(l AS TIMESTAMP), INTERVAL 1 DAY)) AS dd FROM s),
h AS (SELECT g.t, g.f, CAST(g.dd AS DATE) AS d, coalesce(sum(u.r), 0) AS r, count(u.r) AS n FROM g LEFT JOIN u ON u.t = g.t AND u.d = CAST(g.dd AS
DATE) GROUP BY 1, 2, 3),
w AS (SELECT t, f, d, r, n, date_diff('day', f, d) AS i, sum(r) OVER (PARTITION BY t ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s7,
  sum(r) OVER (PARTITION BY t ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS s30 FROM h)"""

SQL = {
    "p3_found": f"""WITH {_KEPT} SELECT t AS tenant_id, strftime(d, '%Y-%m-%d') AS usage_day, CASE WHEN s7 = 0 THEN 'quiet' ELSE 'surge' END AS kind
FROM w WHERE i >= 29 AND s30 > 0 AND (s7 = 0 OR 4 * s7 >= 3 * s30)""",
    "p3_totals": f"""WITH {_KEPT} SELECT t AS tenant_id, strftime(d, '%Y-%m-%d') AS usage_day, CAST(r AS BIGINT) AS rows_day, CAST(n AS BIGINT) AS messages, CAST(s7 AS BIGINT) AS sum_7,
round(s7 / CAST(least(i + 1, 7) AS DOUBLE), 6) AS avg_7, CAST(s30 AS BIGINT) AS sum_30, round(s30 / CAST(least(i + 1, 30) AS DOUBLE), 6) AS avg_30
FROM w""",
    "p4_found": """WITH v AS (SELECT DISTINCT id, entity_id, property, valid_from, valid_to, recorded_at, supersedes_fact_id FROM facts WHERE status IN ('ACTIVE', 'SUPERSEDED')),
w AS (SELECT *, lead(valid_from) OVER o AS nf, lead(id) OVER o AS ni, lag(id) OVER o AS pi FROM v WINDOW o AS (PARTITION BY entity_id, property ORDER
BY valid_from, recorded_at, id))
SELECT id AS fact_id, 'valid_to' AS field FROM w WHERE ni IS NOT NULL AND valid_to IS DISTINCT FROM nf
UNION ALL SELECT id, 'supersedes_fact_id' FROM w WHERE lower(supersedes_fact_id) IS DISTINCT FROM lower(pi)""",
    "p5_found": """WITH k AS (SELECT delivery_id, delivered_at, CASE WHEN id IS NOT NULL THEN 'e' || regexp_replace(lower(id), '[^0-9a-f]', '', 'g') ELSE 'm' || message_id END AS msg FROM api_usage_events)
SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY msg ORDER BY delivered_at, delivery_id) AS n FROM k) t WHERE n > 1""",
}
