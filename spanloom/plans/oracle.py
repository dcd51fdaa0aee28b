"""The same answers in SQL, written against the test tables without using any Spark code."""

from __future__ import annotations

SHIFT = 946080000000000000
HOUR = 3_600_000_000
DAY = 86_400_000_000
GAP = 10 * HOUR
REPORT_GAP = 600 * DAY
METRICS_GAP = 100 * DAY
LIMIT_2020 = 1577836800000000000
ORDER = "ORDER BY received_at, payload_id, pos"
ID = "trace_id, session_no"

LINES = f"""
lines AS (
  SELECT l.*, (l_partkey + l_suppkey) % 4 AS role, (l_suppkey % 7 - 3) * 1000001 AS ahead,
    epoch_us(l_shipdate) * 1000 + CASE WHEN l_returnflag = 'R' THEN 0 ELSE {SHIFT} END AS s,
    CASE WHEN l_quantity = 1 THEN 500 ELSE CAST(l_quantity AS BIGINT) * 1000000 END AS d
  FROM lineitem l),
reports AS (
  SELECT o_orderkey AS trace_id, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey * 16 END AS span_id, CAST(0 AS BIGINT) AS parent_id,
    'order-' || o_orderstatus AS name, 'customer-' || (o_custkey % 10) AS service,
    epoch_us(o_orderdate) * 1000 + {SHIFT} AS start_ns, CAST(2000000000 AS BIGINT) AS duration_ns,
    CAST(0 AS BIGINT) AS cs, CAST(0 AS BIGINT) AS cr, CAST(0 AS BIGINT) AS ss, CAST(0 AS BIGINT) AS sr,
    [{{'k': 'priority', 'v': o_orderpriority}}] AS tags,
    epoch_us(o_orderdate) AS received_at, CAST(-1 AS BIGINT) AS payload_id, CAST(0 AS BIGINT) AS pos
  FROM orders
  UNION ALL
  SELECT l_orderkey, l_orderkey * 16 + l_linenumber, l_orderkey * 16 + l_linenumber // 2,
    CASE WHEN l_tax = 0 THEN '' ELSE 'line-' || l_linenumber || '-' || l_linestatus END,
    CASE WHEN l_tax = 0.01 THEN '' ELSE 'supplier-' || (l_suppkey % 10) END,
    s, d,
    CASE WHEN role IN (0, 2) THEN s ELSE 0 END, CASE WHEN role IN (0, 2) THEN s + d ELSE 0 END,
    CASE WHEN role IN (1, 2) THEN s + d + ahead ELSE 0 END,
    CASE WHEN role IN (1, 2) THEN s + ahead ELSE 0 END,
    list_filter([{{'k': 'flag', 'v': l_returnflag}},
                 {{'k': 'part', 'v': CAST(l_partkey % 100 AS VARCHAR)}},
                 {{'k': 'error', 'v': CASE l_discount WHEN 0 THEN '0' WHEN 0.01 THEN 'false'
                                     WHEN 0.02 THEN '' WHEN 0.03 THEN 'timeout' END}}],
                lambda t: t.v IS NOT NULL),
    epoch_us(l_shipdate), l_partkey, l_suppkey
  FROM lines)"""

VALID = f"""{LINES},
valid AS (SELECT *, CAST(1 AS BIGINT) AS session_no, sr > 0 OR ss > 0 AS srv
          FROM reports WHERE trace_id <> 0 AND span_id <> 0)"""


def merged_from(source: str) -> str:
    """CTEs `merged` and `merged_tags` over reports with session_no and srv."""
    key = f"{ID}, span_id"
    return f"""
tag_values AS (
  SELECT {key}, t.k AS k,
    coalesce(last(t.v {ORDER}) FILTER (WHERE srv), first(t.v {ORDER})) AS v
  FROM (SELECT {key}, received_at, payload_id, pos, srv, unnest(tags) AS t FROM {source})
  GROUP BY ALL),
merged_tags AS (
  SELECT {key}, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS tags
  FROM tag_values GROUP BY ALL),
folded AS (
  SELECT {key},
    coalesce(first(parent_id {ORDER}) FILTER (WHERE parent_id <> 0), 0) AS parent_id,
    coalesce(last(name {ORDER}) FILTER (WHERE srv AND name <> ''),
             first(name {ORDER}) FILTER (WHERE name <> ''), '') AS name,
    coalesce(last(service {ORDER}) FILTER (WHERE srv AND service <> ''),
             first(service {ORDER}) FILTER (WHERE service <> ''), '') AS service,
    first(start_ns {ORDER}) AS start_ns, first(duration_ns {ORDER}) AS duration_ns,
    coalesce(last(cs {ORDER}) FILTER (WHERE NOT srv AND cs > 0), first(cs {ORDER})) AS cs,
    coalesce(last(cr {ORDER}) FILTER (WHERE NOT srv AND cr > 0), first(cr {ORDER})) AS cr,
    coalesce(last(ss {ORDER}) FILTER (WHERE ss > 0), first(ss {ORDER})) AS ss,
    coalesce(last(sr {ORDER}) FILTER (WHERE sr > 0), first(sr {ORDER})) AS sr,
    min(received_at) AS first_at, first(payload_id {ORDER}) AS payload_id, first(pos {ORDER}) AS pos,
    max(received_at) AS last_at, count(*) AS reports
  FROM {source} GROUP BY ALL),
merged AS (
  SELECT f.* RENAME (first_at AS received_at), coalesce(t.tags, '') AS tags
  FROM folded f LEFT JOIN merged_tags t USING ({key}))"""


MERGED = f"{VALID}, {merged_from('valid')}"


def roots_of(source: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT m.* FROM {source} m LEFT JOIN (
    SELECT DISTINCT trace_id AS t, session_no AS s, span_id AS known FROM {source}) p
    ON t = m.trace_id AND s = m.session_no AND known = m.parent_id
  WHERE known IS NULL OR m.parent_id = m.span_id)"""


TREE = f"""{roots_of('merged', 'candidates')},
fakes AS (
  SELECT {ID}, min(parent_id) AS span_id, trace_id AS parent_id, 'fake-root' AS name,
    'fake-root' AS service, min(start_ns) AS start_ns,
    max(start_ns + duration_ns) - min(start_ns) AS duration_ns
  FROM candidates GROUP BY trace_id, session_no
  HAVING count(*) > 1 AND min(parent_id) = max(parent_id)),
grown AS (
  SELECT {ID}, span_id, parent_id, name, service, start_ns, duration_ns, cs, cr, ss, sr, tags, reports
  FROM merged
  UNION ALL
  SELECT {ID}, span_id, parent_id, name, service, start_ns, duration_ns, 0, 0, 0, 0, '', 0 FROM fakes),
{roots_of('grown', 'final_roots')},
unique_traces AS (SELECT {ID} FROM final_roots GROUP BY ALL HAVING count(*) = 1),
kept AS (SELECT * FROM grown SEMI JOIN unique_traces USING ({ID}))"""

KNOWN = "{0}cs <> 0 AND {0}cr <> 0 AND {0}ss <> 0 AND {0}sr <> 0"
SKEW = (
    "CASE WHEN " + KNOWN + " THEN ({0}cr + {0}cs) // 2 - ({0}sr + {0}ss) // 2 ELSE 0 END"
)
WALK = f"""
walk AS (
  SELECT {ID}, span_id, CASE WHEN {KNOWN.format('')} THEN cs ELSE start_ns END AS start_ns,
    CASE WHEN {KNOWN.format('')} THEN cr - cs ELSE duration_ns END AS duration_ns,
    {SKEW.format('')} AS shift
  FROM final_roots SEMI JOIN unique_traces USING ({ID})
  UNION ALL
  SELECT c.trace_id, c.session_no, c.span_id,
    CASE WHEN CASE WHEN {KNOWN.format('c.')} THEN c.cs ELSE c.start_ns END + w.shift < {LIMIT_2020}
         THEN w.start_ns
         ELSE CASE WHEN {KNOWN.format('c.')} THEN c.cs ELSE c.start_ns END + w.shift END,
    CASE WHEN {KNOWN.format('c.')} THEN c.cr - c.cs ELSE c.duration_ns END,
    w.shift + {SKEW.format('c.')}
  FROM kept c JOIN walk w ON c.trace_id = w.trace_id AND c.session_no = w.session_no
    AND c.parent_id = w.span_id AND c.span_id <> c.parent_id),
corrected AS (
  SELECT k.* REPLACE (w.start_ns AS start_ns, w.duration_ns AS duration_ns)
  FROM kept k JOIN walk w USING ({ID}, span_id) WHERE k.span_id <> 0)"""

SPAN = "trace_id, span_id, parent_id, name, service, start_ns, duration_ns"


def sessions_from(source: str, gap: int, max_spans: int) -> str:
    """CTEs `cut` (rows with session_no) and `judged` (sessions)."""
    return f"""
opened AS (
  SELECT *, CASE WHEN received_at - lag(received_at) OVER (PARTITION BY trace_id {ORDER}) < {gap}
                 THEN 0 ELSE 1 END AS opens
  FROM {source}),
cut AS (
  SELECT * EXCLUDE (opens), CAST(sum(opens) OVER (PARTITION BY trace_id {ORDER}) AS BIGINT) AS session_no
  FROM opened),
extents AS (
  SELECT {ID}, min(received_at) AS first_us, max(received_at) AS last_us, count(*) AS arrivals
  FROM cut GROUP BY ALL),
sizes AS (
  SELECT {ID}, count(DISTINCT span_id) FILTER (WHERE received_at <= first_us + 5 * {gap}) AS node_count
  FROM cut JOIN extents USING ({ID}) GROUP BY ALL),
own AS (
  SELECT *, CASE WHEN node_count > {max_spans} THEN 'too_large'
                 WHEN last_us - first_us > 4 * {gap} THEN 'too_old' ELSE 'closed' END AS own_status
  FROM extents JOIN sizes USING ({ID})),
judged AS (
  SELECT {ID},
    CASE WHEN coalesce(max(own_status <> 'closed') OVER (
           PARTITION BY trace_id ORDER BY session_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           false) THEN 'blacklisted' ELSE own_status END AS status,
    first_us, last_us, arrivals, node_count, least(last_us + {gap}, first_us + 5 * {gap}) AS closed_us
  FROM own)"""


ARRIVALS = """
arrived AS (
  SELECT user_id AS trace_id, event_id AS span_id, event_id // 2 AS parent_id, event_type AS name,
    'user-' || (user_id % 10) AS service, epoch_us(ts) AS received_at, event_id AS payload_id,
    CAST(0 AS BIGINT) AS pos
  FROM events WHERE user_id <> 0 AND event_id <> 0)"""

JUDGED = f"{ARRIVALS}, {sessions_from('arrived', GAP, 25)}"

_BAD = "status IN ('too_large', 'too_old')"
BLACKLIST = f"""{JUDGED},
listed AS (SELECT trace_id, min(closed_us) AS since_us FROM judged WHERE {_BAD} GROUP BY ALL)"""

REPORT_SESSIONS = f"""{LINES},
flagged AS (SELECT *, sr > 0 OR ss > 0 AS srv FROM reports WHERE trace_id <> 0 AND span_id <> 0),
{sessions_from('flagged', REPORT_GAP, 8192)},
closed AS (SELECT cut.* FROM cut JOIN judged USING ({ID}) WHERE status = 'closed'),
{merged_from('closed')}"""

FULL = f"""{REPORT_SESSIONS}, {TREE}, {WALK},
emitted AS (SELECT c.*, j.closed_us FROM corrected c JOIN judged j USING ({ID}))"""

OUTCOMES = f"""{REPORT_SESSIONS}, {TREE},
outcomes AS (
  SELECT j.trace_id, j.session_no,
    CASE WHEN j.status <> 'closed' THEN j.status WHEN u.trace_id IS NULL THEN 'no_root'
         ELSE 'finished' END AS status,
    j.node_count, j.arrivals, j.closed_us
  FROM judged j LEFT JOIN unique_traces u USING ({ID}))"""

def ticks_from(
    source: str, times: str, n: int, steps: list[tuple[int, int]], max_open: int, extra: int, states: str = "'closed'",
) -> str:
    """CTEs of `n` ticks over a table of reports, in slices of the time that `times` takes up:
    `outcomes`, `kept` and `gauges`, and `merged` for traces that end in one of `states`.

    Each tick is written out: reports that the blacklist lets through join the open ones, and the
    load of all open traces decides the gap. `extra` microseconds after the last report there is
    one more tick, if that is not 0.
    """
    last = n if extra else n - 1
    reached = " ".join(f"WHEN open_spans >= {low} THEN {s}" for low, s in reversed(steps))
    gap = f"CAST(CASE {reached} END AS BIGINT)"
    parts = [f"""
span_of_time AS (SELECT min(received_at) AS low, max(received_at) AS high FROM {times}),
sliced AS MATERIALIZED (
  SELECT r.*, sr > 0 OR ss > 0 AS srv, (received_at - low) // ((high - low) // {n} + 1) AS slice
  FROM {source} r, span_of_time),
open_0 AS (SELECT * FROM sliced WHERE false),
black_0 AS (SELECT CAST(0 AS BIGINT) AS trace_id, CAST(0 AS BIGINT) AS since_us WHERE false)"""]
    for k in range(1, last + 2):
        now = f"max(received_at) FILTER (WHERE slice < {k})" if k <= n else f"max(received_at) + {extra}"
        parts.append(f"""
valid_{k} AS (SELECT * FROM sliced WHERE slice = {k - 1} AND trace_id <> 0 AND span_id <> 0),
held_{k} AS MATERIALIZED (
  SELECT * FROM open_{k - 1} UNION ALL SELECT * FROM valid_{k} ANTI JOIN black_{k - 1} USING (trace_id)),
now_{k} AS (SELECT {now} AS now_us FROM sliced),
traces_{k} AS (
  SELECT trace_id, count(DISTINCT span_id) AS node_count, min(received_at) AS started, max(received_at) AS updated
  FROM held_{k} GROUP BY trace_id),
load_{k} AS (
  SELECT now_us, open_spans, {gap} AS gap_s FROM now_{k}, (
    SELECT coalesce(sum(node_count) FILTER (WHERE node_count <= 8192), 0) AS open_spans FROM traces_{k})),
judged_{k} AS MATERIALIZED (
  SELECT trace_id, node_count, CASE WHEN node_count > 8192 THEN 'too_large'
    WHEN started < now_us - 5000000 * gap_s THEN 'too_old'
    WHEN updated <= now_us - 1000000 * gap_s THEN 'closed' END AS status
  FROM traces_{k}, load_{k}),
running_{k} AS (
  SELECT trace_id, node_count, sum(node_count) OVER () AS total,
    coalesce(sum(node_count) OVER (ORDER BY node_count DESC, {TIE} // 65536, {TIE}, trace_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM judged_{k} WHERE status IS NULL),
shed_{k} AS MATERIALIZED (
  SELECT trace_id, node_count FROM running_{k}, load_{k}
  WHERE open_spans > {max_open} AND total - gone >= {max_open}),
staying_{k} AS MATERIALIZED (
  SELECT trace_id FROM judged_{k} ANTI JOIN shed_{k} USING (trace_id) WHERE status IS NULL),
open_{k} AS MATERIALIZED (SELECT * FROM held_{k} SEMI JOIN staying_{k} USING (trace_id)),
black_{k} AS MATERIALIZED (
  SELECT * FROM (
    SELECT * FROM black_{k - 1} UNION ALL
    SELECT trace_id, now_us FROM judged_{k}, load_{k} WHERE status IN ('too_large', 'too_old'))
  ORDER BY since_us DESC, trace_id DESC LIMIT 1023)""")
    every = range(1, last + 2)
    closed = " UNION ALL ".join(
        f"SELECT h.*, CAST({k - 1} AS BIGINT) AS session_no FROM held_{k} h SEMI JOIN "
        f"(SELECT trace_id FROM judged_{k} WHERE status IN ({states})) USING (trace_id)" for k in every
    )
    ended = " UNION ALL ".join(
        f"SELECT trace_id, node_count, status, {k - 1} AS session_no FROM judged_{k} WHERE status IS NOT NULL "
        f"UNION ALL SELECT trace_id, node_count, 'discarded', {k - 1} FROM shed_{k}" for k in every
    )
    gauges = " UNION ALL ".join(
        f"SELECT now_us, CAST(open_spans AS BIGINT) AS open_spans, CAST(gap_s AS BIGINT) AS gap_s, "
        f"(SELECT count(*) FROM staying_{k}) AS open_traces, "
        f"(SELECT count(*) FROM valid_{k} SEMI JOIN black_{k - 1} USING (trace_id)) AS blacklisted_reports, "
        f"{k - 1} AS batch FROM load_{k}" for k in every
    )
    return ",".join(parts) + f""",
closed AS MATERIALIZED ({closed}),
{merged_from('closed')}, {TREE},
outcomes AS (
  SELECT e.trace_id, e.node_count, e.session_no AS batch,
    CASE WHEN e.status <> 'closed' THEN e.status WHEN u.trace_id IS NULL THEN 'no_root' ELSE 'finished' END AS status
  FROM ({ended}) e LEFT JOIN unique_traces u ON u.trace_id = e.trace_id AND u.session_no = e.session_no),
gauges AS ({gauges})"""


TIE = """(((trace_id % 2147483648) * 2654435761 % 4294967296
  + (trace_id // 2147483648) % 2147483648 * 2246822519 % 4294967296) % 4294967296)"""
_TICKED = ("reports", "reports", 4, [(0, 300 * 86_400), (15_000, 200 * 86_400)], 20_000, 10 * 365 * DAY)
TICKS = f"{LINES}, {ticks_from(*_TICKED)}"

# Payload fields, per lineitem.
PAYLOAD = f"""
p AS (
  SELECT l_orderkey AS trace_id, l_orderkey * 16 + l_linenumber AS span_id,
    l_orderkey * 16 + l_linenumber // 2 AS parent_id, 'line-' || l_linenumber AS name,
    'supplier-' || (l_suppkey % 10) AS service,
    epoch_us(l_shipdate) * 1000 + {SHIFT} AS at_ns,
    CAST(l_quantity * 1000 - 1000 AS BIGINT) * 1000 AS long_ns,
    CASE WHEN l_quantity = 1 THEN 1000000 ELSE CAST(l_quantity * 1000 - 1000 AS BIGINT) * 1000 END AS d,
    (l_partkey + l_suppkey) % 4 AS role, l_returnflag, l_linestatus, l_partkey,
    epoch_us(l_shipdate) AS received_at, l_partkey % 50 = 0 AS spoilt,
    l_partkey * 1000000 + l_suppkey * 8 + l_linenumber AS payload_id
  FROM lineitem)"""

SPAN_COLUMNS = f"{SPAN}, cs, cr, ss, sr, tags, received_at, payload_id, pos"

_CS, _CR = "CASE WHEN role IN (0, 2) THEN at_ns ELSE 0 END", "CASE WHEN role IN (0, 2) THEN {} ELSE 0 END"

V1 = f"""{PAYLOAD},
v1 AS (
  SELECT trace_id, span_id, parent_id, name,
    CASE WHEN role = 3 THEN 'fallback' ELSE service END AS service,
    CASE WHEN role IN (0, 2) THEN at_ns WHEN role = 1 THEN at_ns + 7000 ELSE at_ns END AS start_ns,
    CASE WHEN role = 1 THEN CASE WHEN long_ns = 2000 THEN 1000000 ELSE long_ns - 2000 END
         WHEN long_ns = 0 THEN 1000000 ELSE long_ns END AS duration_ns,
    CASE WHEN role IN (0, 2) THEN at_ns ELSE 0 END AS cs,
    CASE WHEN role IN (0, 2) THEN at_ns + long_ns ELSE 0 END AS cr,
    CASE WHEN role IN (1, 2) THEN at_ns + long_ns + 5000 ELSE 0 END AS ss,
    CASE WHEN role IN (1, 2) THEN at_ns + 7000 ELSE 0 END AS sr,
    'flag=' || l_returnflag || ',protocolVersion=json v1' AS tags,
    received_at, payload_id, CAST(0 AS BIGINT) AS pos
  FROM p WHERE NOT spoilt
  UNION ALL
  SELECT trace_id, span_id % 4294967296, 0, '', '', at_ns, 1000000, 0, 0, 0, 0,
    'none=null,part=' || (l_partkey % 7) || ',protocolVersion=json v1', received_at, payload_id, 1
  FROM p WHERE NOT spoilt)"""

V2 = f"""{PAYLOAD},
v2 AS (
  SELECT trace_id, span_id, parent_id, name, service, at_ns AS start_ns, d AS duration_ns,
    CASE WHEN role = 0 THEN at_ns ELSE 0 END AS cs, CASE WHEN role = 0 THEN at_ns + d ELSE 0 END AS cr,
    CASE WHEN role = 1 THEN at_ns + d ELSE 0 END AS ss, CASE WHEN role = 1 THEN at_ns ELSE 0 END AS sr,
    'flag=' || l_returnflag || ',protocolVersion=json v2' AS tags,
    received_at, payload_id, CAST(0 AS BIGINT) AS pos
  FROM p WHERE NOT spoilt)"""

JAEGER = f"""{PAYLOAD},
pairs AS (
  SELECT p.*, 0 AS i FROM p WHERE NOT spoilt UNION ALL SELECT p.*, 1 AS i FROM p WHERE NOT spoilt),
jaeger AS (
  SELECT trace_id, CASE WHEN i = 0 THEN span_id ELSE span_id - 1152921504606846976 END AS span_id,
    CASE WHEN i = 0 THEN parent_id ELSE span_id - 1152921504606846976 END AS parent_id,
    name, CASE WHEN role = 3 THEN '' ELSE service END AS service, at_ns AS start_ns, d AS duration_ns,
    CASE WHEN role IN (0, 2) THEN at_ns ELSE 0 END AS cs,
    CASE WHEN role IN (0, 2) THEN at_ns + d ELSE 0 END AS cr,
    CASE WHEN role IN (1, 3) THEN at_ns + d ELSE 0 END AS ss,
    CASE WHEN role IN (1, 3) THEN at_ns ELSE 0 END AS sr,
    'lc=' || l_returnflag || ',protocolVersion=jaeger,status=' || l_linestatus AS tags,
    received_at, payload_id, i * 4294967296 AS pos
  FROM pairs)"""

OPEN = f"""{VALID},
open AS (SELECT trace_id, count(DISTINCT span_id) AS node_count FROM valid GROUP BY ALL)"""

TAG_LIST = "array_to_string(list_sort(list_transform(tags, lambda t: t.k || '=' || t.v)), ',')"
RAW_COLUMNS = f"{SPAN}, cs, cr, ss, sr, {TAG_LIST} AS tags, received_at, payload_id, pos"
HEX = "lpad(printf('%x', {0}), 16, '0')"


JSON_SIZE = f"""octet_length(encode('{{"trace_id":"' || {HEX.format('trace_id')} || '","span_id":"'
    || {HEX.format('span_id')} || '","parent_id":"' || {HEX.format('parent_id')}
    || '","name":"' || name || '","service":"' || service || '","start_ns":' || start_ns
    || ',"duration_ns":' || duration_ns || ',"tags":{{'
    || array_to_string(list_transform(tags, lambda t: '"' || t.k || '":"' || t.v || '"'), ',')
    || '}}}}'))"""
BUCKET = "{0} - {0} % (1::BIGINT << greatest(length(bin({0})) - 8, 0)::INT)"


def sketched(source: str, key: str, shares: dict[str, str]) -> str:
    """Quantiles per key of a table (key, value), each value cut to its eight leading bits."""
    names = ", ".join(f"min(low) FILTER (WHERE place >= ceil(CAST({q} AS DOUBLE) * total)) AS {name}" for name, q in shares.items())
    return f"""SELECT {key}, count(*) AS n, min(low) AS smallest, max(low) AS largest, {names} FROM (
          SELECT {key}, {BUCKET.format('value')} AS low, count(*) OVER (PARTITION BY {key}) AS total,
            row_number() OVER (PARTITION BY {key} ORDER BY value) AS place FROM {source} WHERE value IS NOT NULL) GROUP BY {key}"""


def _rfc(ns: str) -> str:
    digits = f"rtrim(lpad(CAST({ns} % 1000000000 AS VARCHAR), 9, '0'), '0')"
    return f"""strftime(make_timestamp({ns} // 1000), '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN {ns} % 1000000000 = 0 THEN '' ELSE '.' || {digits} END || 'Z'"""


def outline(levels: int, kids: int) -> str:
    """CTEs `lines_out` and `outlined` of the traces in `merged`, whose roots are `candidates`."""
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {ID}, parent_id ORDER BY span_id DESC) AS rank
  FROM merged WHERE span_id <> parent_id),
kid_counts AS (SELECT {ID}, parent_id AS up, count(*) AS n FROM ranked GROUP BY ALL),
listing AS (
  SELECT {ID}, span_id, parent_id, name, 0 AS level,
    upper({HEX.format('9223372036854775807 - span_id')}) AS path
  FROM candidates
  UNION ALL
  SELECT r.trace_id, r.session_no, r.span_id, r.parent_id, r.name, l.level + 1,
    l.path || '/' || lpad(CAST(r.rank AS VARCHAR), 10, '0')
  FROM listing l JOIN ranked r ON r.trace_id = l.trace_id AND r.session_no = l.session_no
    AND r.parent_id = l.span_id AND r.rank <= {kids}
  WHERE l.level < {levels}),
lines_out AS (
  SELECT l.*, coalesce(n, 0) AS n FROM listing l LEFT JOIN kid_counts k
    ON k.trace_id = l.trace_id AND k.session_no = l.session_no AND k.up = l.span_id),
outlined AS (
  SELECT {ID}, level, path, name || ' [' || {HEX.format('span_id')} || ']' AS text, parent_id, span_id FROM lines_out
  UNION ALL
  SELECT {ID}, level + 1, path || '/~',
    CASE WHEN level = {levels} THEN '[...]' ELSE '[... ' || (n - {kids}) || ' more children]' END,
    span_id, 0 FROM lines_out WHERE (level = {levels} AND n > 0) OR n > {kids})"""


def flushes(limit: int, interval: int, order: str) -> str:
    """CTEs `placed` and `walk` (a row per trace, in the order of its shard) of the traces in `ready`, in three shards."""
    wait = interval * 9 // 10
    tick = f"(greatest(w.at_us, w.flushed_us + {wait}) + {interval - 1}) // {interval} * {interval}"
    return f"""
placed AS (
  SELECT *, trace_id % 3 AS shard, row_number() OVER (PARTITION BY trace_id % 3 ORDER BY {order}) AS n FROM ready),
walk AS (
  SELECT shard, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS flushed_us,
    CAST(0 AS BIGINT) AS at_us, CAST(0 AS BIGINT) AS batch FROM placed WHERE n = 1
  UNION ALL
  SELECT shard, n,
    CASE WHEN total >= {limit} THEN 0 ELSE total END,
    CASE WHEN total >= {limit} THEN closed_us WHEN due THEN tick_us ELSE flushed_us END,
    closed_us, batch + CAST(due AS BIGINT) + CAST(was_full AS BIGINT)
  FROM (
    SELECT *, CAST(CASE WHEN due THEN 0 ELSE held END + node_count AS BIGINT) AS total FROM (
      SELECT w.shard, p.n, w.held, w.flushed_us, w.batch, p.closed_us, p.node_count, w.held = 0 AND w.n > 0 AS was_full,
        {tick} AS tick_us, w.held > 0 AND {tick} < p.closed_us AS due
      FROM walk w JOIN placed p ON p.shard = w.shard AND p.n = w.n + 1)))"""


_PERCENTILES = """
  count(*) AS traces, min({0}) AS smallest, max({0}) AS largest"""

ORACLE: dict[str, str] = {
    "ingest_zipkin_v1": f"WITH {V1} SELECT {SPAN_COLUMNS} FROM v1",
    "ingest_zipkin_v2": f"WITH {V2} SELECT {SPAN_COLUMNS} FROM v2",
    "ingest_jaeger": f"WITH {JAEGER} SELECT {SPAN_COLUMNS} FROM jaeger",
    "dead_letters": f"""WITH {PAYLOAD}
        SELECT payload_id, protocol, 'bad_span' AS reason
        FROM p CROSS JOIN (VALUES ('json-v1'), ('json-v2'), ('jaeger')) t(protocol) WHERE spoilt""",
    "ingest_metrics": f"""WITH {PAYLOAD}
        SELECT protocol, count(*) AS payloads, count(*) FILTER (WHERE spoilt) AS rejects,
          count(*) FILTER (WHERE NOT spoilt) * any_value(per) AS spans
        FROM p CROSS JOIN (VALUES ('json-v1', 2), ('json-v2', 1), ('jaeger', 2)) t(protocol, per)
        GROUP BY protocol""",
    **{name: f"""WITH {PAYLOAD}
        SELECT received_at - received_at % {width} AS window_us, protocol, count(*) AS payloads,
          count(*) FILTER (WHERE spoilt) AS rejects, count(*) FILTER (WHERE NOT spoilt) * any_value(per) AS spans
        FROM p CROSS JOIN (VALUES ('json-v1', 2), ('json-v2', 1), ('jaeger', 2)) t(protocol, per)
        GROUP BY 1, 2""" for name, width in (("ingest_by_hour", 3_600_000_000), ("ingest_stream_counts", 60_000_000))},
    "id_text": f"""WITH i AS (
          SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 123457 ELSE -o_orderkey * 9871 END AS id
          FROM orders),
        u AS (SELECT id, CASE WHEN id < 0 THEN CAST(id AS HUGEINT) + 18446744073709551616
                              ELSE CAST(id AS HUGEINT) END AS n FROM i)
        SELECT id, {HEX.format('CAST(n AS UBIGINT)')} AS text, id AS parsed,
          CAST(n AS VARCHAR) AS unsigned, CAST(n % 4096 AS BIGINT) AS short FROM u""",
    "time_units": f"""WITH {LINES}, n AS (
          SELECT *, start_ns + duration_ns - span_id AS ns FROM reports)
        SELECT trace_id, span_id, ns, ns // 1000 AS us, (-ns) // 1000000 AS ms,
          (ns // 1000) * 1000 AS back,
          (ns - {SHIFT} - (((ns - {SHIFT}) % 1000) + 1000) % 1000) // 1000 AS at_us,
          parent_id = span_id AS is_root, parent_id <> span_id AS has_parent,
          parent_id = 0 AS unknown_parent, cs > 0 AS valid_cs FROM n""",
    "valid_spans": f"WITH {ARRIVALS} SELECT trace_id, span_id, parent_id, name, service FROM arrived",
    "merge_spans": f"WITH {MERGED} SELECT * EXCLUDE (session_no) FROM merged",
    "merge_spans_by_rows": f"WITH {MERGED} SELECT * EXCLUDE (session_no) FROM merged",
    "sessionize": f"WITH {JUDGED} SELECT {ID}, span_id, received_at FROM cut",
    "classify_sessions": f"""WITH {JUDGED}
        SELECT {ID}, status, first_us, last_us, arrivals, closed_us FROM judged""",
    "blacklist": f"WITH {BLACKLIST} SELECT * FROM listed",
    "cap_blacklist": f"""WITH {BLACKLIST}
        SELECT * FROM listed ORDER BY since_us DESC, trace_id DESC LIMIT 20""",
    "apply_blacklist": f"""WITH {BLACKLIST}, {LINES}
        SELECT trace_id, span_id, payload_id, pos FROM reports ANTI JOIN listed USING (trace_id)""",
    "closed_spans": f"""WITH {JUDGED}
        SELECT {ID}, span_id, last_us + {GAP} AS closed_us, arrivals
        FROM cut JOIN judged USING ({ID}) WHERE status = 'closed'""",
    "adaptive_gap": f"""WITH {ARRIVALS}
        SELECT trace_id, count(*) * 1500 AS open_spans,
          CAST(CASE WHEN count(*) * 1500 >= 80000 THEN 2 WHEN count(*) * 1500 >= 60000 THEN 4
               WHEN count(*) * 1500 >= 40000 THEN 6 ELSE 8 END AS BIGINT) AS gap_s
        FROM arrived GROUP BY trace_id""",
    "inflight": f"""WITH {OPEN}
        SELECT CAST(sum(node_count) FILTER (WHERE node_count <= 4) AS BIGINT) AS open_spans,
          count(*) AS open_traces FROM open""",
    "shed_largest": f"""WITH {OPEN},
        hashed AS (SELECT *, ((trace_id % 2147483648) * 2654435761 % 4294967296
            + (trace_id // 2147483648) % 2147483648 * 2246822519 % 4294967296) % 4294967296 AS h FROM open),
        running AS (
          SELECT trace_id, node_count, sum(node_count) OVER () AS total,
            coalesce(sum(node_count) OVER (ORDER BY node_count DESC, h // 65536, h, trace_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
          FROM hashed)
        SELECT trace_id, node_count FROM running WHERE total - gone >= 20000""",
    "roots": f"WITH {MERGED}, {roots_of('merged', 'candidates')} SELECT {SPAN} FROM candidates",
    "children": f"""WITH {MERGED}
        SELECT c.trace_id, c.span_id, c.parent_id, c.name, c.service, c.start_ns, c.duration_ns,
          p.name AS parent_name, p.service AS parent_service
        FROM merged c JOIN merged p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id
        WHERE c.span_id <> c.parent_id""",
    "by_parent": f"""WITH {MERGED}
        SELECT trace_id, parent_id, span_id, count(*) OVER (PARTITION BY trace_id, parent_id) AS n
        FROM merged""",
    "trace_root": f"""WITH {ARRIVALS}
        SELECT a.trace_id, a.span_id, a.parent_id, a.name, a.service,
          epoch_us(e.ts) * 1000 AS start_ns,
          CAST(round(e.value * 1000) * 1000 AS BIGINT) AS duration_ns
        FROM arrived a JOIN events e ON e.event_id = a.span_id WHERE a.span_id = a.trace_id""",
    "get_span": f"WITH {MERGED} SELECT {SPAN} FROM merged WHERE trace_id = 100 AND span_id = 1603",
    "has_span": f"""WITH {MERGED}, wanted AS (SELECT DISTINCT trace_id, parent_id AS span_id FROM merged)
        SELECT w.trace_id, w.span_id, m.span_id IS NOT NULL AS present
        FROM wanted w LEFT JOIN merged m USING (trace_id, span_id)""",
    "same_parent": f"""WITH {MERGED}, {roots_of('merged', 'candidates')}
        SELECT trace_id, count(*) AS candidates, min(parent_id) = max(parent_id) AS same_parent,
          min(parent_id) AS parent_id FROM candidates GROUP BY trace_id""",
    "fake_roots": f"WITH {MERGED}, {TREE} SELECT {SPAN} FROM fakes",
    "unique_root": f"WITH {MERGED}, {TREE} SELECT trace_id, span_id, parent_id, name FROM kept",
    "clock_skew": f"""WITH {MERGED}
        SELECT trace_id, span_id, {SKEW.format('')} AS skew_ns FROM merged""",
    "correct_timings_by_joins": f"WITH RECURSIVE {MERGED}, {TREE}, {WALK} SELECT {SPAN}, tags FROM corrected",
    "correct_traces_by_rows": f"WITH RECURSIVE {MERGED}, {TREE}, {WALK} SELECT {SPAN}, tags FROM corrected",
    "trace_verdicts": f"""WITH {MERGED}, {TREE}
        SELECT m.trace_id, count(*) AS node_count, any_value(f.trace_id IS NOT NULL) AS faked,
          any_value(CASE WHEN u.trace_id IS NULL THEN 'no_root' ELSE 'finished' END) AS status
        FROM merged m LEFT JOIN fakes f USING ({ID}) LEFT JOIN unique_traces u USING ({ID})
        GROUP BY m.trace_id""",
    "trace_outline": f"""WITH RECURSIVE {MERGED}, {roots_of('merged', 'candidates')}, {outline(2, 1)}
        SELECT * EXCLUDE (session_no) FROM outlined""",
    "dropped_outlines": f"""WITH RECURSIVE {LINES}, {ticks_from(*_TICKED, "'closed', 'too_large', 'too_old'")}, {outline(6, 32)}
        SELECT l.* EXCLUDE (session_no), o.status, o.batch FROM outlined l
        JOIN outcomes o ON o.trace_id = l.trace_id AND o.batch = l.session_no
        WHERE o.status IN ('no_root', 'too_large', 'too_old')""",
    "corrected_spans": f"""WITH RECURSIVE {FULL}
        SELECT {ID}, span_id, parent_id, name, service, start_ns, duration_ns, cs, cr, ss, sr, tags,
          reports, closed_us FROM emitted""",
    "convert_hook": f"""WITH {MERGED}
        SELECT {SPAN.replace('service', 'upper(service) AS service')} FROM merged WHERE name <> ''""",
    "convert_hook_by_rows": f"""WITH {MERGED}
        SELECT {SPAN.replace('service', 'upper(service) AS service')} FROM merged WHERE name <> ''""",
    "agent_spans": f"""WITH RECURSIVE {MERGED}, {TREE}, {WALK}
        SELECT CASE WHEN name = '' THEN '(resource empty)' ELSE name END AS resource,
          service AS name, service, start_ns AS start, greatest(duration_ns, 1000) AS duration,
          CAST(span_id AS VARCHAR) AS span_id, CAST(trace_id AS VARCHAR) AS trace_id,
          CAST(parent_id AS VARCHAR) AS parent_id, tags AS meta, true AS sampled,
          CASE WHEN tags LIKE 'error=%' AND NOT (tags LIKE 'error=false,%' OR tags LIKE 'error=0,%')
               THEN 1 ELSE 0 END AS error
        FROM corrected""",
    "sink_batches": f"""WITH {OUTCOMES}, placed AS (
          SELECT *, CAST(floor(closed_us / 2592000000000) AS BIGINT) AS flush, trace_id % 3 AS shard
          FROM outcomes WHERE status = 'finished'),
        running AS (
          SELECT *, coalesce(sum(node_count) OVER (PARTITION BY flush, shard
            ORDER BY closed_us, trace_id, session_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
        SELECT flush, shard, CAST(floor(before / 10) AS BIGINT) AS batch, count(*) AS traces,
          CAST(sum(node_count) AS BIGINT) AS spans FROM running GROUP BY 1, 2, 3""",
    "trace_batches": f"""WITH RECURSIVE {FULL}
        SELECT CAST(floor(closed_us / {DAY}) AS BIGINT) AS day, trace_id, count(*) AS n,
          string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY span_id) AS span_ids
        FROM emitted GROUP BY 1, 2""",
    "recent_spans": f"""WITH RECURSIVE {FULL}
        SELECT {ID}, span_id, parent_id, name, service, start_ns, duration_ns, closed_us FROM emitted
        ORDER BY closed_us DESC, trace_id DESC, session_no DESC, span_id LIMIT 2048""",
    "span_json": f"""WITH {MERGED}, listed_tags AS (
          SELECT {ID}, span_id, string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) AS t
          FROM tag_values GROUP BY ALL)
        SELECT trace_id, span_id,
          '{{"id":"' || {HEX.format('span_id')} || '","parent":"' || {HEX.format('parent_id')}
          || '","trace":"' || {HEX.format('trace_id')} || '","name":"' || name
          || '","service":"' || service || '","timestamp":"' || {_rfc('start_ns')}
          || '","duration":' || duration_ns || ',"tags":{{' || t || '}}'
          || ',"timings":{{"cs":"' || {_rfc('cs')} || '","cr":"' || {_rfc('cr')}
          || '","ss":"' || {_rfc('ss')} || '","sr":"' || {_rfc('sr')} || '"}}}}' AS json
        FROM merged JOIN listed_tags USING ({ID}, span_id)""",
    "trace_outcomes": f"""WITH {OUTCOMES}
        SELECT {ID}, status, arrivals, closed_us FROM outcomes""",
    "outcome_metrics": f"""WITH {OUTCOMES}
        SELECT coalesce(status, 'all') AS status, count(*) AS traces,
          CAST(sum(node_count) AS BIGINT) AS spans FROM outcomes GROUP BY ROLLUP (status)""",
    "outcomes_by_minute": f"""WITH {OUTCOMES}, placed AS (
          SELECT closed_us - closed_us % 60000000 AS window_us, status, node_count FROM outcomes)
        SELECT coalesce(window_us, -1) AS window_us, coalesce(status, 'all') AS status, count(*) AS traces,
          CAST(sum(node_count) AS BIGINT) AS spans FROM placed GROUP BY ROLLUP (window_us, status)""",
    "exact_batches": f"""WITH RECURSIVE {OUTCOMES}, ready AS (SELECT * FROM outcomes WHERE status = 'finished'),
        {flushes(10, 30 * DAY, 'closed_us, trace_id, session_no')}
        SELECT w.shard, count(*) AS traces, CAST(sum(node_count) AS BIGINT) AS spans, min(closed_us) AS first_us, max(closed_us) AS last_us
        FROM walk w JOIN placed p ON p.shard = w.shard AND p.n = w.n GROUP BY w.shard, w.batch""",
    "flushed_stream": f"""WITH RECURSIVE {TICKS}, ready AS (
          SELECT o.trace_id, o.batch, o.node_count, g.now_us AS closed_us, (
            SELECT count(*) FROM kept k WHERE k.trace_id = o.trace_id AND k.session_no = o.batch) AS emitted
          FROM outcomes o JOIN gauges g USING (batch) WHERE status = 'finished'),
        {flushes(100, 500 * DAY, 'closed_us, batch, trace_id')},
        batches AS (
          SELECT w.shard, w.batch, count(*) AS traces, CAST(sum(emitted) AS BIGINT) AS spans, min(closed_us) AS first_us,
            max(closed_us) AS last_us, min(held) = 0 AS was_full
          FROM walk w JOIN placed p ON p.shard = w.shard AND p.n = w.n GROUP BY w.shard, w.batch)
        SELECT shard, traces, spans, first_us, last_us, was_full OR last_us < (SELECT max(now_us) FROM gauges)
          OR batch < max(batch) OVER (PARTITION BY shard) AS flushed FROM batches""",
    "exchange_readers": f"""WITH {LINES}
        SELECT reader, (trace_id % 7 + 7) % 7 AS trace_mod, count(*) AS reports, CAST(sum(span_id) AS BIGINT) AS span_ids
        FROM reports CROSS JOIN (VALUES ('fast'), ('slow')) t(reader) GROUP BY 1, 2""",
    "size_distribution": f"""WITH {JUDGED}
        SELECT count(*) AS traces, min(node_count) AS smallest, max(node_count) AS largest,
          CAST(sum(node_count) AS DOUBLE) / count(*) AS mean,
          quantile_cont(node_count, 0.5) AS p50, quantile_cont(node_count, 0.75) AS p75,
          quantile_cont(node_count, 0.95) AS p95, quantile_cont(node_count, 0.99) AS p99
        FROM judged""",
    "span_metrics": f"""WITH {LINES},
        flagged AS (SELECT *, sr > 0 OR ss > 0 AS srv FROM reports WHERE trace_id <> 0 AND span_id <> 0),
        {sessions_from('flagged', METRICS_GAP, 5)},
        placed AS (
          SELECT status, received_at > first_us + 5 * {METRICS_GAP} AS late
          FROM cut JOIN judged USING ({ID})),
        kept_spans AS (
          SELECT {ID}, span_id, count(*) AS reports FROM cut JOIN judged USING ({ID})
          WHERE status = 'closed' GROUP BY ALL)
        SELECT CAST((SELECT sum(reports - 1) FROM kept_spans) AS BIGINT) AS merged_reports,
          (SELECT count(*) FROM kept_spans) AS spans,
          count(*) FILTER (WHERE status = 'blacklisted' OR {_BAD} AND late) AS blacklisted,
          count(*) FILTER (WHERE {_BAD} AND NOT late) AS dropped
        FROM placed""",
    "payload_size": f"""WITH {LINES}, sized AS (
          SELECT {JSON_SIZE} AS size FROM reports)
        SELECT count(*) AS spans, CAST(min(size) AS INT) AS smallest, CAST(max(size) AS INT) AS largest,
          quantile_cont(size, 0.5) AS p50, quantile_cont(size, 0.99) AS p99 FROM sized""",
    "trace_size_quantiles": f"""WITH {OUTCOMES}, sized AS (SELECT status, node_count AS value FROM outcomes)
        {sketched('sized', 'status', {'p50': '0.5', 'p75': '0.75', 'p95': '0.95', 'p99': '0.99'})}""",
    "span_bytes_by_year": f"""WITH {LINES}, sized AS (
          SELECT CAST(year(received) AS INT) AS year, CAST({JSON_SIZE} AS BIGINT) AS value
          FROM (SELECT *, make_timestamp(received_at) AS received FROM reports))
        {sketched('sized', 'year', {'p50': '0.5', 'p95': '0.95', 'p99': '0.99'})}""",
    "sharded_exchange": f"WITH {LINES} SELECT {RAW_COLUMNS} FROM reports",
    "topic_records": f"WITH {LINES} SELECT {RAW_COLUMNS} FROM reports",
    "keyed_stream": f"""WITH {JUDGED}
        SELECT CASE WHEN trace_id % 2 = 1 THEN -trace_id ELSE trace_id END AS trace_id, session_no,
          span_id, cut.parent_id, cut.name, service, received_at * 1000 AS start_ns,
          CAST(round(e.value * 1000) * 1000 AS BIGINT) AS duration_ns, 'props=' || e.props AS tags,
          received_at, CAST(1 AS BIGINT) AS reports, last_us + {GAP} AS closed_us
        FROM cut JOIN judged USING ({ID}) JOIN events e ON e.event_id = cut.span_id
        WHERE status = 'closed'""",
    "tick_stream": f"WITH {TICKS} SELECT trace_id, node_count, status, batch FROM outcomes",
    "tick_gauges": f"WITH {TICKS} SELECT * FROM gauges",
    "compressed_payloads": f"""
        SELECT CAST(s_nationkey + 1 AS BIGINT) AS trace_id, s_suppkey AS span_id, CAST(0 AS BIGINT) AS parent_id,
          s_name AS name, '' AS service, s_suppkey * 1000000 + {SHIFT} AS start_ns,
          CASE WHEN s_suppkey % 100 = 0 THEN 1000000 ELSE s_suppkey % 100 * 1000 END AS duration_ns,
          CAST(0 AS BIGINT) AS cs, CAST(0 AS BIGINT) AS cr,
          s_suppkey * 1000000 + {SHIFT} + CASE WHEN s_suppkey % 100 = 0 THEN 1000000 ELSE s_suppkey % 100 * 1000 END AS ss,
          s_suppkey * 1000000 + {SHIFT} AS sr, 'nation=' || s_nationkey || ',protocolVersion=json v2' AS tags
        FROM supplier""",
    "fan_out": f"WITH {MERGED} SELECT {SPAN}, sink FROM merged CROSS JOIN (VALUES ('columns'), ('lines')) t(sink)",
    "payload_stream": f"""WITH {V1}, {V2.removeprefix(PAYLOAD + ",")}, {JAEGER.removeprefix(PAYLOAD + ",")},
        spans AS (
          SELECT {SPAN}, cs, cr, ss, sr, [{{'k': 'k', 'v': tags}}] AS tags, received_at, payload_id, pos
          FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT {SPAN_COLUMNS} FROM jaeger)),
        {ticks_from('spans', 'p', 2, [(0, 100 * 86_400)], 100_000, 0)},
        placed AS (
          SELECT p.*, (received_at - low) // ((high - low) // 2 + 1) AS batch
          FROM p, (SELECT min(received_at) AS low, max(received_at) AS high FROM p))
        SELECT status AS what, batch, count(*) AS n, CAST(sum(node_count) AS BIGINT) AS total FROM outcomes GROUP BY ALL
        UNION ALL SELECT 'dead', batch, 3 * count(*), CAST(3 * sum(payload_id) AS BIGINT) FROM placed WHERE spoilt GROUP BY ALL
        UNION ALL SELECT 'ingested', batch, 3 * count(*), 5 * count(*) FILTER (WHERE NOT spoilt) FROM placed GROUP BY ALL
        UNION ALL SELECT 'emitted', session_no, count(*), CAST(sum(span_id % 1000) AS BIGINT) FROM kept GROUP BY ALL""",
}
