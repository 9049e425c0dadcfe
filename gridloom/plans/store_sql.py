"""The store's queries as SQL over the whole tables."""

_SAMPLES = "samples AS (SELECT user_id::VARCHAR AS entity_id, ts, value, event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31')"
# Of several samples of one instant the last one counts before a grid point and the first one after it.
_GRID = f"""{_SAMPLES},
points AS (SELECT entity_id, ts, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM samples GROUP BY ALL),
grid AS (SELECT entity_id, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL '6 hours')) AS g FROM (SELECT DISTINCT entity_id FROM samples) x),
prev AS (SELECT grid.entity_id, g, p.ts AS pt, p.last_value AS pv FROM grid ASOF LEFT JOIN points p ON grid.entity_id = p.entity_id AND grid.g >= p.ts),
around AS (SELECT prev.*, n.ts AS nt, n.first_value AS nv FROM prev ASOF LEFT JOIN points n ON prev.entity_id = n.entity_id AND prev.g <= n.ts)"""


def _interpolated(value: str) -> str:
    return f"WITH {_GRID} SELECT entity_id, g AS ts, round({value}, 6) AS value FROM around WHERE ({value}) IS NOT NULL"


_STATE = "SELECT user_id || '/' || event_type AS Id, arg_max(value, (ts, event_id)) AS value, arg_max(props, (ts, event_id)) AS props FROM events WHERE ts >= TIMESTAMP '{0}' AND ts < TIMESTAMP '{1}' GROUP BY user_id, event_type"
_STATES = f"old AS ({_STATE.format('2024-01-08', '2024-01-15')}), new AS ({_STATE.format('2024-01-15', '2024-01-22')})"
_PAIRS = f"""{_STATES}, pairs AS (SELECT coalesce(o.Id, n.Id) AS EntityId, o.Id AS oid, n.Id AS nid, o.value AS ov, n.value AS nv, o.props AS op, n.props AS np,
    CASE WHEN o.Id IS NULL THEN 'Insert' WHEN n.Id IS NULL THEN 'Delete' ELSE 'Update' END AS kind FROM old o FULL OUTER JOIN new n ON o.Id = n.Id)"""
_EVENTS = f"""{_PAIRS}, changes AS (SELECT EntityId, kind AS Operation, CASE WHEN kind = 'Update' THEN
        concat_ws(',', CASE WHEN op IS DISTINCT FROM np THEN 'props' END, CASE WHEN ov IS DISTINCT FROM nv THEN 'value' END) ELSE '' END AS changed,
        CASE WHEN kind = 'Update' AND op IS DISTINCT FROM np THEN np END AS new_props,
        kind = 'Update' AND op IS DISTINCT FROM np AS props_changed, kind = 'Update' AND ov IS DISTINCT FROM nv AS value_changed
    FROM pairs WHERE kind <> 'Update' OR op IS DISTINCT FROM np OR ov IS DISTINCT FROM nv)"""
_HASH = "base64(unhex(sha256(coalesce({0}::VARCHAR, ''))))"
_CHAIN = f"""chain AS (SELECT user_id::VARCHAR AS EntityId, ts AS Timestamp, event_id AS Id, {_HASH.format('event_type')} AS Hash,
    coalesce(lag({_HASH.format('event_type')}) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS PreviousHash FROM events)"""
_DISTANCE = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))))"
_MATCHES = f"""WITH {_EVENTS} SELECT 'a' AS AnalyticsId, EntityId, Operation FROM changes WHERE Operation <> 'Update' OR value_changed
    UNION ALL SELECT 'b', EntityId, Operation FROM changes WHERE Operation <> 'Update' OR props_changed"""

SQL = {
    "crud_find_predicate": "SELECT * FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'",
    "crud_find_page": "SELECT * FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 50 OFFSET 100",
    "crud_find_by_id": "SELECT * FROM customer WHERE c_custkey = 42",
    "crud_count": "SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS n_large FROM orders",
    "crud_in_list": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')))",
    "crud_dynamic_rows": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS data, 1.0::DOUBLE AS score FROM nation""",
    "catalog_tables": "SELECT unnest(['customer', 'nation', 'orders']) AS table_name",
    "sql_params": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'MACHINERY'",
    "sql_join_like": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%1%'",
    "sql_agg5": """SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_price, round(sum(o_totalprice), 2) AS sum_price,
        count(*) AS n, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price FROM orders GROUP BY o_orderpriority""",
    "sql_surface": """SELECT 'rollup' AS part, coalesce(o_orderstatus, '') AS k1, coalesce(o_orderpriority, '') AS k2, count(DISTINCT o_custkey) AS n
        FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
        UNION ALL SELECT 'window', o_orderstatus, r::VARCHAR, count(*) FROM
            (SELECT o_orderstatus, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) x GROUP BY 1, 2, 3
        UNION ALL SELECT 'subquery', c_mktsegment, '', count(*) FROM customer
            WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) GROUP BY c_mktsegment
        UNION ALL SELECT 'except', '', '', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) y""",
    "ts_encode": """WITH base AS (SELECT user_id, value, min(ts) AS base_ts FROM events GROUP BY ALL),
        o AS (SELECT e.user_id, e.value, base_ts, (epoch_us(ts) - epoch_us(base_ts)) // 1000 AS ms FROM events e JOIN base b ON e.user_id = b.user_id AND e.value = b.value)
        SELECT user_id::VARCHAR AS entity_id, value, base_ts, count(*) AS n_obs, sum(ms)::BIGINT AS sum_offsets, max(ms) AS last_offset FROM o GROUP BY ALL""",
    "ts_range_read": """WITH base AS (SELECT user_id, value, min(ts) AS base_ts FROM events GROUP BY ALL),
        o AS (SELECT e.user_id, e.value, make_timestamp(epoch_us(base_ts) + (epoch_us(ts) - epoch_us(base_ts)) // 1000 * 1000) AS ts FROM events e JOIN base b ON e.user_id = b.user_id AND e.value = b.value)
        SELECT user_id::VARCHAR AS entity_id, ts, value FROM o WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'""",
    "ts_interp_linear": _interpolated("CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((epoch_us(g) - epoch_us(pt))::DOUBLE / (epoch_us(nt) - epoch_us(pt))) END"),
    "ts_interp_nearest": _interpolated("CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv WHEN epoch_us(g) - epoch_us(pt) <= epoch_us(nt) - epoch_us(g) THEN pv ELSE nv END"),
    "ts_interp_previous": _interpolated("pv"),
    "ts_interp_next": _interpolated("nv"),
    "ts_interp_none": """SELECT user_id::VARCHAR AS entity_id, date_trunc('minute', ts)::TIMESTAMP AS ts, arg_min(value, event_id) AS value FROM events
        WHERE date_trunc('minute', ts) BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' AND minute(ts) % 15 = 0 GROUP BY 1, 2""",
    "ts_delta_codec": """SELECT true AS same, count(*) AS n, sum(list_sum(list_transform(deltas, lambda d: 1 + greatest(1, ceil(log2(abs(d) + 1) / 7)))))::BIGINT AS n_bytes FROM systimeseriesdeltas""",
    "ts_delta_read": """WITH b AS (SELECT DISTINCT lower(id) AS k, table_name, split_part(property_name, '.', 1) AS property_name, reading_timestamp FROM systimeseriesbasevalues),
        d AS (SELECT DISTINCT id, lower(base_value_id) AS k, deltas FROM systimeseriesdeltas WHERE base_value_id IS NOT NULL),
        o AS (SELECT table_name, property_name, reading_timestamp, deltas, unnest(generate_series(1, len(deltas))) AS i FROM b JOIN d USING (k))
        SELECT table_name, property_name, count(*) AS n, max(reading_timestamp + to_milliseconds(list_sum(deltas[1:i])::BIGINT)) AS last FROM o GROUP BY ALL""",
    "vec_codec": "SELECT vec_id, 256::BIGINT AS n_bytes, true AS same FROM embeddings",
    "ts_dsl": """WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-25', INTERVAL '1 hour')) AS ts),
        s AS (SELECT ts AS at, value FROM events WHERE user_id = 13 AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-25')
        SELECT ts, round(value, 2) AS value FROM g ASOF JOIN s ON g.ts >= s.at""",
    "trigger_throttle": """WITH RECURSIVE e AS (SELECT DISTINCT event_type, date_trunc('minute', ts)::TIMESTAMP AS ts FROM events),
        runs AS (SELECT event_type, min(ts) AS t FROM e GROUP BY 1
            UNION ALL SELECT r.event_type, min(e.ts) FROM runs r JOIN e ON e.event_type = r.event_type AND e.ts >= r.t + INTERVAL '6 hours' GROUP BY 1)
        SELECT event_type AS AnalyticsId, count(*) AS runs, max(t) AS last_run FROM runs GROUP BY 1""",
    "ts_dsl_raw": "SELECT ts, value FROM events WHERE user_id = 13 AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-25'",
    "cdc_log": f"""WITH {_PAIRS} SELECT EntityId, 'props' AS PropertyName, kind AS ChangeType, 'System' AS ChangedBy, to_json(op)::VARCHAR AS OriginalValue, to_json(np)::VARCHAR AS NewValue,
        TIMESTAMP '2024-01-22' AS ChangedAt FROM pairs WHERE op IS DISTINCT FROM np""",
    "cdc_counts": f"""WITH {_PAIRS} SELECT 'props' AS PropertyName, kind AS ChangeType, count(*) AS n FROM pairs WHERE op IS DISTINCT FROM np GROUP BY ALL
        UNION ALL SELECT 'value', kind, count(*) FROM pairs WHERE ov IS DISTINCT FROM nv GROUP BY ALL""",
    "cdc_event_map": f"WITH {_EVENTS} SELECT EntityId, Operation, changed, new_props FROM changes",
    "upsert_merge": f"WITH {_STATES} SELECT * FROM old WHERE Id NOT IN (SELECT Id FROM new) UNION ALL SELECT * FROM new",
    "update_existing": f"WITH {_STATES} SELECT o.Id, CASE WHEN n.Id IS NULL THEN o.value ELSE n.value END AS value, CASE WHEN n.Id IS NULL THEN o.props ELSE n.props END AS props FROM old o LEFT JOIN new n ON o.Id = n.Id",
    "delete_anti": f"WITH {_STATES} SELECT * FROM old WHERE Id NOT IN (SELECT Id FROM new)",
    "integrity_hash": f"SELECT c_custkey, {_HASH.format('c_name')} AS name_hash, {_HASH.format('c_custkey')} AS key_hash FROM customer",
    "integrity_chain": f"WITH {_CHAIN} SELECT * FROM chain",
    "integrity_verify": f"""WITH {_CHAIN}, last AS (SELECT EntityId, arg_max(Hash, (Timestamp, Hash)) AS Expected FROM chain GROUP BY ALL),
        now AS (SELECT user_id::VARCHAR AS EntityId, {_HASH.format('arg_min(event_type, (ts, event_id))')} AS Actual FROM events GROUP BY user_id)
        SELECT EntityId, Expected, Actual FROM last JOIN now USING (EntityId) WHERE Expected <> Actual""",
    "integrity_chain_break": f"""WITH {_CHAIN}, kept AS (SELECT *, lag(Hash) OVER (PARTITION BY EntityId ORDER BY Timestamp, Id) AS Expected FROM chain WHERE Hash <> {_HASH.format("'purchase'")})
        SELECT EntityId, Timestamp, Expected, PreviousHash AS Actual FROM kept WHERE Expected IS NOT NULL AND Expected <> PreviousHash""",
    "emb_template_text": """WITH o AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY ALL)
        SELECT c_custkey::VARCHAR AS EntityId, trim('in ' || coalesce(n_name, '') || ' Customer ' || c_name || ' of ' || c_mktsegment
            || ' with ' || coalesce(n, 0) || ' orders from ' || coalesce(a::VARCHAR, '') || ' to ' || coalesce(b::VARCHAR, '')) AS Text
        FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "emb_template_agg": """SELECT c_custkey, coalesce(s, '') AS states, c_name AS name, 'as it is' AS other FROM customer
        LEFT JOIN (SELECT o_custkey, string_agg(o_orderstatus, ' ' ORDER BY o_orderstatus) AS s FROM orders GROUP BY ALL) o ON c_custkey = o_custkey""",
    "vec_l2_topk": f"SELECT e.vec_id, round({_DISTANCE}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DISTANCE}, e.vec_id LIMIT 5",
    "vec_search_join": f"SELECT e.vec_id, e.label, round({_DISTANCE}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DISTANCE}, e.vec_id::VARCHAR LIMIT 10",
    "vec_normalize": """WITH n AS (SELECT label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)
        SELECT label, (i - 1)::INTEGER AS i, round(avg(embedding[i]::DOUBLE / norm), 6) AS mean FROM n, range(1, 65) r(i) GROUP BY ALL""",
    "vec_put_remove": """SELECT vec_id, round((CASE WHEN label IN (3, 4) THEN embedding[64] ELSE embedding[1] END)::DOUBLE, 5) AS first FROM embeddings WHERE label <> 5""",
    "prog_sql": "SELECT 'sql' AS name, count(*)::VARCHAR AS value FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem)",
    "prog_timeseries": "SELECT 'series' AS name, round(arg_max(value, ts), 6) AS value FROM events WHERE user_id = 13 AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'",
    "prog_expr": "SELECT 'expr' AS name, '84' AS value",
    "prog_loop": "SELECT 'loop' AS name, '3' AS value",
    "prog_array_var": "SELECT 'array' AS name, (4 * 4 + 3 * 3)::VARCHAR AS value",
    "prog_rowset": "SELECT 'rowset' AS name, count(DISTINCT c_nationkey)::VARCHAR AS value FROM customer WHERE c_acctbal > 5000",
    "prog_callable": "SELECT 'callable' AS name, '42' AS value",
    "prog_export": "SELECT 'count' AS name, 60 AS run_interval, 'SqlQuery' AS operation, 'SELECT COUNT(*) AS n FROM customer' AS expression, 'n' AS result_variable",
    "prog_step_join": """WITH h AS (SELECT lower(id) AS id, min(program_name) AS program_name FROM sysanalytics GROUP BY 1),
        s AS (SELECT DISTINCT id AS sid, lower(analytics_id) AS id, step_order, operation FROM sysanalyticssteps)
        SELECT id, program_name, count(*) AS n_steps, string_agg(operation, ',' ORDER BY step_order, operation) AS operations FROM h JOIN s USING (id) GROUP BY ALL""",
    "trigger_match": _MATCHES,
    "stream_trigger_feed": _MATCHES,
    "stream_windows": "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS starts FROM events),
        s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM m)
        SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, no""",
    "crud_find_all": "SELECT * FROM supplier",
    "crud_query_entities": "SELECT * FROM supplier WHERE s_acctbal > 5000",
    "write_counts": f"""WITH {_STATES}, b AS (SELECT count(*) AS n FROM old JOIN new USING (Id)), o AS (SELECT count(*) AS n FROM old), w AS (SELECT count(*) AS n FROM new)
        SELECT 'insert' AS step, n FROM o UNION ALL SELECT 'update', n FROM b UNION ALL SELECT 'upsert', n FROM w UNION ALL SELECT 'delete', n FROM o
        UNION ALL SELECT 'delete_all', w.n - b.n FROM w, b UNION ALL SELECT 'left', 0""",
    "write_change_log": f"""WITH {_STATES}, k AS (SELECT 'Insert' AS ChangeType FROM old WHERE props IS NOT NULL
            UNION ALL SELECT CASE WHEN o.Id IS NULL THEN 'Insert' ELSE 'Update' END FROM new n LEFT JOIN old o ON n.Id = o.Id WHERE n.props IS DISTINCT FROM o.props)
        SELECT 'props' AS PropertyName, ChangeType, 'System' AS ChangedBy, count(*) AS n FROM k GROUP BY ChangeType""",
    "write_events": f"""WITH {_STATES}, e AS (SELECT 'stays' AS handler, 'Insert' AS operation, count(*) AS n FROM old
            UNION ALL SELECT 'leaves', 'Insert', count(*) FROM old
            UNION ALL SELECT 'stays', CASE WHEN o.Id IS NULL THEN 'Insert' ELSE 'Update' END, count(*) FROM new n LEFT JOIN old o ON n.Id = o.Id
                WHERE o.Id IS NULL OR n.props IS DISTINCT FROM o.props OR n.value IS DISTINCT FROM o.value GROUP BY ALL)
        SELECT * FROM e""",
    "write_series": f"WITH {_STATES} SELECT Id, count(*) AS n FROM (SELECT Id FROM old UNION ALL SELECT Id FROM new) x GROUP BY Id",
    "write_chain": f"""WITH {_STATES} SELECT Id, count(*) AS links, 1::BIGINT AS firsts, 0 AS wrong FROM (SELECT Id FROM old UNION ALL SELECT Id FROM new) x GROUP BY Id""",
    "val_messages": """SELECT * FROM (VALUES
        ('01 none', 'Analytics must have at least one step.'), ('02 type', 'Step 1 (Nonsense): Invalid step type Nonsense.'),
        ('03 empty', 'Step 1 (SqlQuery): Expression cannot be null or empty.'), ('04 variable', 'Step 2 (CSharp): Unknown variable y'),
        ('05 array', 'Step 2 (CSharp): Array xs must be defined before index access'), ('06 command', 'Step 1 (SqlQuery): Only SELECT queries are allowed.'),
        ('07 table', 'Step 1 (SqlQuery): Invalid table reference nowhere'), ('08 column', 'Step 1 (SqlQuery): Property price does not exist on table orders'),
        ('09 series', 'Step 1 (Timeseries): Timeseries expression must have 5 to 7 components: tableName,entityId,propertyName,start,end[,interval,method]'),
        ('10 boolean', 'Step 2 (Condition): Condition script must return a boolean value'),
        ('11 jump', 'Step 2 (Condition): Invalid GoTo step number 7. Must be between 1 and 2, not current step'),
        ('12 loop', 'Step 2 (Condition): MaxLoop must be positive'), ('13 last', 'Step 1 (CSharp): Last CSharp step must have a ResultVariable'), ('14 fine', 'none'),
        ('15 order', 'Step 3 (SqlQuery): Incorrect order 3. Expected 1.')) t(name, error)""",
    "prog_service": f"""WITH {_STATES}, o AS (SELECT count(*)::VARCHAR AS n FROM orders), s AS (SELECT count(*)::VARCHAR AS n FROM old)
        SELECT 'execute' AS step, n AS value FROM o UNION ALL SELECT 'verify', 'True' UNION ALL SELECT 'zero', n FROM o
        UNION ALL SELECT 'tick', '1' UNION ALL SELECT 'tick again', '0' UNION ALL SELECT 'every', n FROM o UNION ALL SELECT 'change', n FROM s
        UNION ALL SELECT 'throttled', n FROM s UNION ALL SELECT 'restarted in between', n FROM s UNION ALL SELECT 'later', '0' UNION ALL SELECT 'tick later', '1'
        UNION ALL SELECT 'value log', '0>' || n || ',' || n || '>0' FROM s UNION ALL SELECT 'left', 'change,demand'""",
}
