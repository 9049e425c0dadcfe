"""The general problems' queries as SQL over the whole tables, written without the operators' devices."""

_CHANGES = """
changes AS (
    SELECT DISTINCT table_name,
        CASE WHEN table_name = 'sysAnalytics' THEN lower(entity_id) ELSE entity_id END AS entity_id,
        property_name, changed_at, lower(change_type) AS kind,
        CASE WHEN table_name = 'sysAnalytics' THEN original_value ELSE original_value::JSON ->> '$' END AS old,
        CASE WHEN lower(change_type) = 'delete' THEN NULL
             WHEN table_name = 'sysAnalytics' THEN new_value ELSE new_value::JSON ->> '$' END AS new
    FROM syschangelog
    WHERE lower(change_type) IN ('insert', 'update', 'delete') AND changed_at IS NOT NULL
        AND table_name IS NOT NULL AND entity_id IS NOT NULL AND property_name IS NOT NULL),
steps AS (  -- the change of an instant that no other one of it goes on from
    SELECT * FROM changes c
    WHERE NOT EXISTS (SELECT 1 FROM changes d
        WHERE d.table_name = c.table_name AND d.entity_id = c.entity_id AND d.property_name = c.property_name
            AND d.changed_at = c.changed_at AND d.old IS NOT DISTINCT FROM c.new AND d <> c)),
states AS (
    SELECT *, last_value(CASE WHEN kind <> 'update' THEN kind END IGNORE NULLS) OVER
        (PARTITION BY table_name, entity_id, property_name ORDER BY changed_at) AS row_kind
    FROM steps),
held AS (
    SELECT table_name, entity_id, property_name, changed_at,
        CASE WHEN row_kind IS DISTINCT FROM 'delete' THEN new END AS value
    FROM states)"""

_STRETCHES = f"""WITH {_CHANGES},
marked AS (
    SELECT *, lag(value) OVER w IS DISTINCT FROM value OR row_number() OVER w = 1 AS starts
    FROM held WINDOW w AS (PARTITION BY table_name, entity_id, property_name ORDER BY changed_at)),
stretches AS (
    SELECT *, lead(changed_at) OVER (PARTITION BY table_name, entity_id, property_name ORDER BY changed_at) AS ended
    FROM marked WHERE starts)"""

_MICRO = "'%Y-%m-%d %H:%M:%S.%f'"
_SECOND = "'%Y-%m-%d %H:%M:%S'"

_USABLE = """
usable AS (
    SELECT *, try_cast(replace(trim(reading_value, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), ',', '.') AS DOUBLE) AS number
    FROM systimeseriesbasevalues
    WHERE regexp_full_match(trim(reading_value, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?')
        AND reading_timestamp >= TIMESTAMP '2020-01-01 00:00:00'),
slots AS (
    SELECT table_name, entity_id, property_name, time_bucket(INTERVAL '15 minutes', reading_timestamp) AS slot, count(*) AS n,
        max({'t': reading_timestamp, 'v': number}) AS last, min({'t': reading_timestamp, 'v': number}) AS first
    FROM usable GROUP BY ALL),
linked AS (
    SELECT *, lead(slot) OVER w AS next_slot, lead(first) OVER w AS after
    FROM slots WINDOW w AS (PARTITION BY table_name, entity_id, property_name ORDER BY slot)),
grid AS (
    SELECT *, unnest(generate_series(slot, coalesce(next_slot - INTERVAL '15 minutes', slot), INTERVAL '15 minutes')) AS slot_start FROM linked)"""

_REFS = """
parents AS (
    SELECT 'base' AS space, lower(id) AS k, min(received_at) AS first FROM systimeseriesbasevalues GROUP BY ALL
    UNION ALL SELECT 'sysAnalytics', lower(id), min(received_at) FROM sysanalytics GROUP BY ALL
    UNION ALL SELECT 'Sensors', id, min(received_at) FROM sensors GROUP BY ALL
    UNION ALL SELECT 'Rooms', id, min(received_at) FROM rooms GROUP BY ALL),
gone AS (
    SELECT DISTINCT table_name AS space, CASE WHEN table_name = 'sysAnalytics' THEN lower(entity_id) ELSE entity_id END AS k
    FROM syschangelog WHERE lower(change_type) = 'delete'),
refs AS (
    SELECT 'systimeseriesdeltas' AS source_table, id AS record_id, 'base' AS space, lower(base_value_id) AS k, min(received_at) AS referred_at
    FROM systimeseriesdeltas WHERE base_value_id IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'sysanalyticssteps', id, 'sysAnalytics', lower(analytics_id), min(received_at)
    FROM sysanalyticssteps WHERE analytics_id IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'sysembeddings', id, table_name, entity_id, min(received_at)
    FROM sysembeddings WHERE entity_id IS NOT NULL AND table_name IS NOT NULL GROUP BY ALL),
states AS (
    SELECT source_table, record_id, referred_at, CASE WHEN first > referred_at THEN 'late' WHEN first IS NOT NULL THEN 'ok'
        WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS ref_state
    FROM refs LEFT JOIN parents USING (space, k) LEFT JOIN gone g USING (space, k))"""

SQL = {
    "p2_found": f"""{_STRETCHES} SELECT table_name, entity_id, property_name, strftime(changed_at, {_MICRO}) AS valid_from,
        coalesce(strftime(ended, {_MICRO}), '') AS valid_to FROM stretches WHERE value IS NOT NULL""",
    "p2_history": f"""{_STRETCHES} SELECT table_name, entity_id, property_name, value, strftime(changed_at, {_MICRO}) AS valid_from,
        strftime(ended, {_MICRO}) AS valid_to FROM stretches WHERE value IS NOT NULL""",
    "p3_found": f"""WITH {_USABLE} SELECT table_name, entity_id, property_name, strftime(slot_start, {_SECOND}) AS slot_start FROM grid WHERE slot_start > slot""",
    "p3_series": f"""WITH {_USABLE} SELECT table_name, entity_id, property_name, strftime(slot_start, {_SECOND}) AS slot_start,
        CASE WHEN slot_start > slot THEN 0 ELSE n END::BIGINT AS n, slot_start > slot AS is_missing,
        CASE WHEN slot_start = slot THEN round(last.v, 6) END AS slot_value,
        CASE WHEN slot_start > slot THEN round(last.v, 6) END AS previous_value,
        CASE WHEN slot_start > slot THEN round(after.v, 6) END AS next_value,
        CASE WHEN slot_start > slot THEN round(last.v + (after.v - last.v) * ((epoch_us(slot_start) - epoch_us(last.t))::DOUBLE / (epoch_us(after.t) - epoch_us(last.t))), 6) END AS linear_value FROM grid""",
    "p5_found": f"WITH {_REFS} SELECT source_table, record_id, ref_state FROM states WHERE ref_state <> 'ok'",
    "p5_report": f"""WITH {_REFS}, counted AS (SELECT source_table, date_trunc('month', referred_at)::TIMESTAMP AS m, ref_state, count(*) AS n FROM states GROUP BY ALL)
        SELECT source_table, strftime(m, {_SECOND}) AS period, ref_state, n, share FROM (
            SELECT *, round(n / sum(n) OVER (PARTITION BY source_table, m), 6) AS share FROM counted) WHERE ref_state <> 'ok'""",
    "p6_found": f"""WITH {_CHANGES} SELECT table_name, entity_id, property_name, arg_max(value, changed_at) AS current_value FROM (
            SELECT table_name, entity_id, property_name, changed_at, {{'v': value}} AS value FROM held)
        GROUP BY ALL""".replace("arg_max(value, changed_at) AS current_value", "arg_max(value, changed_at).v AS current_value") + " HAVING current_value IS NOT NULL",
}
