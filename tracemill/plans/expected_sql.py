"""DuckDB statements that compute the same answers as the registered queries."""

from __future__ import annotations

from tracemill.operators import audit, labelled
from tracemill.operators import validate as rules
from tracemill.schemas import COUNTERS, FEATURES, GRAMS, MAXIMA, OPERATIONS, SUMS

DAY = 86_400_000_000_000
HOUR = 3_600_000_000_000

TEL = """tel AS (
  SELECT 'run-' || CASE WHEN user_id % 10 < 6 THEN 0 ELSE user_id % 10 - 5 END AS run_id,
    2 * (event_id + CASE WHEN event_id % 17 = 0 THEN 400 ELSE 0 END)
      + CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END AS pos,
    event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS ts_ns,
    'b0' AS boot_id, user_id AS tgid, CAST(0 AS BIGINT) AS start_time_ns,
    event_id % 97 = 0 AS is_exit,
    CASE event_type WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' ELSE 'O' END AS op,
    CASE WHEN event_type = 'error' THEN -1 ELSE 0 END AS result,
    CASE WHEN event_id % 97 <> 0 AND event_id % 211 = 0
      AND date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 5 = 0 THEN 3 ELSE 0 END AS lost
  FROM events)"""

OK = f"""ok AS (
  SELECT *, ts_ns - ts_ns % {DAY} AS start_ns FROM mark WHERE NOT is_exit AND result >= 0)"""

MARK = """mark AS (
  SELECT *, max(ts_ns) OVER (PARTITION BY run_id ORDER BY pos) AS w,
    max(ts_ns) OVER (PARTITION BY run_id) AS run_end FROM tel)"""

KEY = "run_id, boot_id, tgid, start_time_ns, start_ns"

FIRST = f"""first_pos AS (SELECT {KEY}, min(pos) AS p FROM ok GROUP BY ALL),
fx AS (
  SELECT f.run_id, f.boot_id, f.tgid, f.start_time_ns, f.start_ns, min(x.pos) AS exit_pos
  FROM mark x JOIN first_pos f ON x.is_exit AND f.run_id = x.run_id AND f.tgid = x.tgid
   AND f.start_ns = x.w - x.w % {DAY} AND x.pos > f.p GROUP BY ALL)"""

LATE = f"""late AS (
  SELECT o.run_id, o.boot_id, o.tgid, o.start_time_ns, o.start_ns,
    CAST(count(*) FILTER (o.start_ns + {DAY} <= o.w OR o.pos > coalesce(fx.exit_pos, 9223372036854775807)) AS BIGINT)
      AS late_event_count,
    max(fx.exit_pos) IS NOT NULL AS partial_by_exit,
    max(fx.exit_pos) IS NOT NULL OR o.start_ns + {DAY} > max(o.run_end) AS partial
  FROM ok o LEFT JOIN fx USING (run_id, boot_id, tgid, start_time_ns, start_ns) GROUP BY 1, 2, 3, 4, 5)"""

COUNTS = f"""counts AS (
  SELECT {KEY}, {", ".join(f"count(*) FILTER (op = '{o}') AS {o}_sum" for o in OPERATIONS)}
  FROM ok GROUP BY ALL)"""

PEAKS = f"""peaks AS (
  SELECT {KEY}, {", ".join(f"max(n_{o}) AS {o}_max_1s" for o in OPERATIONS)} FROM (
    SELECT {KEY}, (ts_ns - start_ns) // {HOUR} AS h,
      {", ".join(f"count(*) FILTER (op = '{o}') AS n_{o}" for o in OPERATIONS)}
    FROM ok GROUP BY ALL) GROUP BY {KEY})"""

TRI = f"""tri AS (
  SELECT {KEY}, {", ".join(f"count(*) FILTER (g = '{g}') AS {g}" for g in GRAMS)} FROM (
    SELECT {KEY}, op || lead(op, 1) OVER q || lead(op, 2) OVER q AS g FROM ok
    WINDOW q AS (PARTITION BY {KEY} ORDER BY seq)) GROUP BY {KEY})"""

LOSS = f"""loss AS (
  SELECT run_id, CASE WHEN ts_ns > 0 AND ts_ns % {DAY} = 0 THEN ts_ns - {DAY}
      ELSE ts_ns - ts_ns % {DAY} END AS start_ns, CAST(sum(lost) AS BIGINT) AS loss_count
  FROM tel WHERE lost > 0 GROUP BY ALL)"""

FULL = f"""full_windows AS (
  SELECT *, CASE WHEN flags = '' THEN 'complete' ELSE flags END AS quality,
    NOT partial AND loss_count = 0 AS complete,
    NOT partial AND loss_count = 0 AND late_event_count = 0 AS classifiable,
    sha256('["' || run_id || '","' || boot_id || '",' || tgid || ',' || start_time_ns || ','
      || start_ns || ',' || end_ns || ',2]') AS window_id
  FROM (
    SELECT {KEY}, start_ns + {DAY} AS end_ns, CAST(2 AS BIGINT) AS feature_version,
      {", ".join(SUMS + MAXIMA + GRAMS)}, partial, coalesce(loss_count, 0) AS loss_count,
      late_event_count, concat_ws(',', CASE WHEN partial THEN 'partial' END,
        CASE WHEN loss_count > 0 THEN 'loss' END,
        CASE WHEN late_event_count > 0 THEN 'late' END) AS flags
    FROM counts JOIN peaks USING ({KEY}) JOIN tri USING ({KEY}) JOIN late USING ({KEY})
    LEFT JOIN loss USING (run_id, start_ns)))"""

WINDOWS = f"WITH {TEL}, {MARK}, {OK}, {FIRST}, {LATE}, {COUNTS}, {PEAKS}, {TRI}, {LOSS}, {FULL}"
BASE = f"WITH {TEL}, {MARK}, {OK}"

SCORED = """scored AS (
  SELECT window_id, run_id, boot_id, tgid, start_time_ns, start_ns, end_ns, classifiable,
    'rule-success-count-rate-v2' AS model_version,
    CASE WHEN classifiable THEN (C_sum + D_sum) / 10.0 END AS score, CAST(0.2 AS DOUBLE) AS threshold,
    CASE WHEN classifiable THEN (C_sum + D_sum) / 10.0 >= 0.2 END AS suspicious, quality,
    '[["C_sum",' || C_sum || '],["D_sum",' || D_sum || ']]' AS supporting_features
  FROM full_windows)"""

REC = """body AS (
  SELECT 'rec-' || (event_id % 20) AS recording, event_id % 20 AS slot,
    event_id // 20 + 1 AS pos,
    CASE WHEN event_id % 20 = 4 AND event_id // 20 + 1 = 5 THEN 'run-other' ELSE 'run-' || (event_id % 20) END AS run_id,
    CASE WHEN (event_id // 20) % 10 = 3 THEN 'heartbeat' WHEN event_id % 97 = 0 THEN 'process_exit' ELSE 'event' END AS type,
    event_id // 20 + 1 + CASE WHEN event_id % 20 = 1 AND event_id // 20 + 1 > 7 THEN 1 ELSE 0 END AS seq,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS ts_ns, event_type, event_id, user_id
  FROM events),
rec AS (
  SELECT *,
    CASE WHEN type <> 'process_exit' THEN CASE WHEN slot = 5 AND pos = 4 THEN 2 ELSE 0 END END AS lost,
    type = 'event' AND slot = 3 AND pos % 11 = 0 AS degraded,
    type = 'event' AND slot = 2 AND event_id % 5 = 2 AND pos % 3 = 0 AS unfinished
  FROM body),
envelope AS (
  SELECT recording, slot, 'run-' || slot AS run_id, max(pos) AS n, max(ts_ns) AS end_ns, sum(lost) AS lost FROM rec GROUP BY ALL)"""


def _verdicts() -> str:
    def flag(condition: str, text: str) -> str:
        return f"CASE WHEN {condition} THEN '{text}' END"

    flags = [
        flag("slot = 6", rules.BEGIN),
        flag("slot = 8", rules.END),
        flag("slot IN (8, 10)", rules.STATUS),
        flag("n_runs > 1", rules.RUN_ID),
        flag("bad_steps > 0 OR first_seq <> 1 OR (slot <> 8 AND last_seq + 1 <> n + CASE slot WHEN 1 THEN 2 ELSE 1 END)", rules.SEQUENCE),
        flag("slot = 9", rules.BOUNDARY),
        flag("slot = 11", rules.LOSS_TOTAL),
        flag("lost > 0", rules.LOSSY),
        flag("n_degraded > 0", rules.DEGRADED),
        flag("n_unfinished > 0", rules.NO_RESULT),
    ]
    return f"""WITH {REC}, steps AS (
      SELECT *, seq - lag(seq) OVER (PARTITION BY recording ORDER BY pos) AS step FROM rec),
    agg AS (
      SELECT recording, slot, max(pos) AS n, count(*) AS body_records, count(DISTINCT run_id) AS n_runs,
        count(*) FILTER (step <> 1) AS bad_steps, arg_min(seq, pos) AS first_seq, arg_max(seq, pos) AS last_seq,
        CAST(coalesce(sum(lost), 0) AS BIGINT) AS lost, count(*) FILTER (degraded) AS n_degraded,
        count(*) FILTER (unfinished) AS n_unfinished,
        count(*) FILTER (type = 'event') AS event_count, count(*) FILTER (type = 'heartbeat') AS heartbeat_count,
        count(*) FILTER (type = 'process_exit') AS process_exit_count
      FROM steps GROUP BY recording, slot),
    flagged AS (
      SELECT *, concat_ws('; ', {", ".join(flags)}) AS violations FROM agg)
    SELECT recording, CASE WHEN slot <> 6 THEN 'run-' || slot END AS run_id,
      body_records + CASE WHEN slot IN (6, 8) THEN 1 ELSE 2 END AS records,
      event_count, heartbeat_count, process_exit_count, lost AS observed_loss,
      violations = '' AS accepted, violations FROM flagged"""



US = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))"

CONTRACT = f"""lines AS (
  SELECT event_id AS n, 'file-' || (event_id % 3) AS recording, event_id AS pos, user_id, {US} * 1000 AS ts_ns,
    CASE WHEN event_id % 73 = 0 THEN 'blank JSONL record' WHEN event_id % 71 = 0 THEN 'invalid JSON'
    ELSE concat_ws('; ',
      CASE WHEN event_id % 67 = 0 THEN 'record has a field that is not known' END,
      CASE WHEN event_id % 31 = 0 THEN 'boot_id is no text or empty' END,
      CASE WHEN event_id % 37 = 0 THEN 'tgid is no integer from 1 to 2^32 - 1' END,
      CASE WHEN event_id % 41 = 0 THEN 'start_time_ns is no integer from 0 to 2^64 - 1' END,
      CASE WHEN event_id % 43 = 0 THEN 'tid is no integer from 1 to 2^32 - 1' END,
      CASE WHEN event_id % 47 = 0 THEN 'operation is none of O, C, D' END,
      CASE WHEN event_id % 53 = 0 THEN 'result is neither null nor a 64-bit integer' END,
      CASE WHEN event_id % 59 = 0 THEN 'filename_bytes_b64 is not base64' END,
      CASE WHEN event_id % 61 = 0 THEN 'lost_events is no integer from 0 to 2^64 - 1' END) END AS violations
  FROM events)"""

RECORDS = f"""{REC},
all_records AS (
  SELECT recording, pos, type, run_id, seq, ts_ns, user_id, lost,
    CASE WHEN type = 'event' THEN CASE event_type WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' ELSE 'O' END END AS op,
    CASE WHEN type = 'event' AND NOT unfinished THEN CASE WHEN event_type = 'error' THEN -1 ELSE 0 END END AS result,
    CASE WHEN type = 'event' THEN CASE WHEN degraded THEN 'degraded' ELSE 'complete' END END AS quality,
    NULL AS status, NULL AS total, NULL AS source FROM rec
  UNION ALL
  SELECT recording, 0, 'run_start', run_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    CASE WHEN slot = 7 THEN 'replay' ELSE 'live' END FROM envelope WHERE slot <> 6
  UNION ALL
  SELECT recording, n + 1, 'run_end', run_id, n + CASE WHEN slot = 1 THEN 2 ELSE 1 END,
    end_ns - CASE WHEN slot = 9 THEN 1 ELSE 0 END, NULL, NULL, NULL, NULL, NULL,
    CASE WHEN slot = 10 THEN 'failed' ELSE 'complete' END, lost + CASE WHEN slot = 11 THEN 1 ELSE 0 END, NULL
  FROM envelope WHERE slot <> 8),
texts AS (
  SELECT recording, pos, CASE type
    WHEN 'run_start' THEN '{{"capture_start_ns":0,"run_id":"' || run_id || '","schema_version":1,"source":"' || source || '","type":"run_start"}}'
    WHEN 'run_end' THEN '{{"collector_sequence":' || seq || ',"run_id":"' || run_id || '","schema_version":1,"status":"' || status
      || '","timestamp_ns":' || ts_ns || ',"total_lost_events":' || total || ',"type":"run_end"}}'
    WHEN 'heartbeat' THEN '{{"collector_sequence":' || seq || ',"lost_events":' || lost || ',"run_id":"' || run_id
      || '","schema_version":1,"timestamp_ns":' || ts_ns || ',"type":"heartbeat"}}'
    WHEN 'process_exit' THEN '{{"collector_sequence":' || seq || ',"process":' || process || ',"run_id":"' || run_id
      || '","schema_version":1,"tid":' || (user_id + 1) || ',"timestamp_ns":' || ts_ns || ',"type":"process_exit"}}'
    ELSE '{{"collector_sequence":' || seq || ',"filename":"f' || pos || '","filename_bytes_b64":null,"lost_events":' || lost
      || ',"operation":"' || op || '","process":' || process || ',"result":' || coalesce(CAST(result AS VARCHAR), 'null')
      || ',"run_id":"' || run_id || '","schema_version":1,"telemetry_quality":"' || quality || '","tid":' || (user_id + 1)
      || ',"timestamp_ns":' || ts_ns || ',"type":"event"}}' END AS value
  FROM (SELECT *, '{{"boot_id":"b0","schema_version":1,"start_time_ns":0,"tgid":' || user_id
    || ',"type":"process_identity"}}' AS process FROM all_records))"""

RAW = f"""raw AS (
  SELECT *, {US} * 1000 AS ts_ns,
    CASE WHEN event_id % 83 = 0 THEN '' WHEN event_id % 79 = 0 THEN '-bad' ELSE 'run-' || (user_id % 5) END AS run_id,
    CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'openat' WHEN 'purchase' THEN 'openat'
      WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'unlink' ELSE 'unlinkat' END
      ELSE CASE WHEN event_id % 5 = 0 THEN 'rename' ELSE 'open' END END AS name,
    (event_id * 37) % 256 AS flags, CASE WHEN event_type = 'error' THEN -2 ELSE event_id % 10 END AS ret,
    event_id % 97 = 0 AS is_exit FROM events),
mapped AS (
  SELECT *, name IN ('open', 'openat') AND (flags & 64) <> 0 AS intent,
    CASE WHEN name IN ('open', 'openat') THEN CASE WHEN (flags & 64) <> 0 THEN 'C' ELSE 'O' END
      WHEN name IN ('unlink', 'unlinkat') THEN 'D' END AS op FROM raw)"""

RAW_FLAGS = """concat_ws('; ', CASE WHEN event_id % 83 = 0 THEN 'run_id is blank' END,
  CASE WHEN NOT is_exit AND event_id % 89 = 0 THEN 'attempt, result or filename of a syscall is missing' END,
  CASE WHEN is_exit AND event_id % 194 = 0 THEN 'process_exit carries fields of a syscall' END,
  CASE WHEN NOT is_exit AND op IS NULL THEN 'syscall is not one that is mapped' END{extra})"""

LOSSES = f"""snap AS (
  SELECT 'run-' || (user_id % 5) AS run_id, event_id AS pos,
    {", ".join(f"CAST(CASE WHEN event_id % 501 = 0 AND {i} = 2 THEN 0 ELSE event_id // {7 + 4 * i} END AS BIGINT) AS c{i}" for i in range(len(COUNTERS)))}
  FROM events)"""


def _labelled(clean: bool) -> str:
    capture = "'cap-' || quality || '-' || (doc_id % 20)" if clean else "'cap-' || (doc_id % 40)"
    slot = "doc_id % 20 * 2" if clean else "doc_id % 40"
    split = f"CASE WHEN {slot} < 24 THEN 'training' WHEN {slot} < 32 THEN 'validation' ELSE 'test' END"
    digest, window, quality = f"sha256({capture})", "sha256(CAST(doc_id AS VARCHAR))", "'good'"
    if not clean:
        split = f"CASE WHEN doc_id % 70 = 3 THEN 'test' ELSE {split} END"
        digest = (f"CASE WHEN doc_id % 50 = 7 THEN sha256('cap-1') WHEN doc_id % 90 = 4 THEN 'short' ELSE {digest} END")
        window = "sha256(CAST(CASE WHEN doc_id % 9 = 1 THEN doc_id - 1 ELSE doc_id END AS VARCHAR))"
        quality = "CASE WHEN doc_id % 33 = 5 THEN 'bad' ELSE 'good' END"
    names = "[" + ",".join(f'"{name}"' for name in FEATURES) + "]"
    return f"""rows AS (
      SELECT doc_id, quality AS label, {window} AS window_id, {capture} AS capture_id, {digest} AS capture_hash,
        {split} AS split, {quality} AS row_quality,
        list_transform(range(33), lambda i: CASE i WHEN 1 THEN n_chars % 60 + 30 * quality WHEN 2 THEN doc_id % 17
          ELSE (n_chars * (i + 1) + doc_id) % 50 END) AS f
      FROM labels JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)),
    texts AS (
      SELECT *, '{{"capture_hash":"' || capture_hash || '","capture_id":"' || capture_id || '","complete":true,"feature_names":{names}'
        || ',"feature_version":2,"features":[' || list_aggregate(list_transform(f, lambda x: x || '.0'), 'string_agg', ',')
        || '],"label":' || label || ',"quality":"' || row_quality || '","split":"' || split || '","window_id":"' || window_id || '"}}' AS text
      FROM rows)"""


CLEAN, BROKEN = f"WITH {_labelled(True)}", f"WITH {_labelled(False)}"


def _digest(keys: str, source: str) -> str:
    return f"""d0 AS (SELECT {keys}, sha256(text) AS d, count(*) AS n FROM {source} GROUP BY ALL),
    d1 AS (SELECT {keys}, substring(d, 1, 6) AS p, sum(n) AS n, sha256(string_agg(d || ':' || n, '' ORDER BY d)) AS d
      FROM d0 GROUP BY {keys}, substring(d, 1, 6)),
    d2 AS (SELECT {keys}, substring(p, 1, 3) AS p, sum(n) AS n, sha256(string_agg(d, '' ORDER BY p)) AS d
      FROM d1 GROUP BY {keys}, substring(p, 1, 3)),
    digests AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS row_count, sha256(string_agg(d, '' ORDER BY p)) AS content_digest
      FROM d2 GROUP BY {keys})"""


ROLES = """roled AS (
  SELECT *, 'all' AS role FROM texts UNION ALL
  SELECT *, CASE WHEN split = 'test' THEN 'test' ELSE 'selection' END FROM texts)"""

PLAN = "plan AS (SELECT * FROM (VALUES " + ", ".join(
    f"({index}, '{name}', '{label}')" for index, (name, label) in enumerate(labelled.SCENARIOS.items())
) + ") AS s(scenario_order, scenario, behavior_label), (VALUES " + ", ".join(
    f"({index}, {seed}, '{split}')" for index, (seed, split) in enumerate(labelled.SPLIT_BY_SEED.items())
) + ") AS t(seed_order, seed, split))"

CAPTURES = f"""agg AS (
  SELECT recording, slot, 'run-' || slot AS run_id, count(*) AS body_records,
    count(*) FILTER (type = 'event') AS event_count, count(*) FILTER (type = 'heartbeat') AS heartbeat_count,
    count(*) FILTER (type = 'process_exit') AS process_exit_count, max(ts_ns) AS end_ns, max(user_id) AS last_user,
    min(user_id) FILTER (type = 'process_exit') AS exiting FROM rec GROUP BY ALL),
cand AS (SELECT *, CASE WHEN slot = 12 THEN -5 ELSE coalesce(exiting, last_user) END AS tracked FROM agg),
tracked AS (
  SELECT c.slot, count(*) FILTER (r.type = 'event') AS n_events, count(*) FILTER (r.type = 'process_exit') AS n_exits
  FROM cand c LEFT JOIN rec r ON r.run_id = c.run_id AND r.user_id = c.tracked AND r.type <> 'heartbeat' GROUP BY 1)"""

SCORES = """scored AS (
  SELECT doc_id, label, capture_id, model, score FROM rows, LATERAL (VALUES
    ('rule', (f[2] + f[3]) / 10.0::DOUBLE), ('rbf_svm', f[6] / 7.0::DOUBLE - 3.0),
    ('random_forest', (doc_id % 101 + label * 30) / 131.0::DOUBLE)) AS m(model, score))"""

SWEEP = """sums AS (
  SELECT model, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY ALL),
cumulated AS (
  SELECT model, score, sum(p) OVER q AS tp, sum(n) OVER q AS fp, sum(p) OVER m AS all_p, sum(n) OVER m AS all_n,
    max(score) OVER m AS top FROM sums
  WINDOW q AS (PARTITION BY model ORDER BY score DESC), m AS (PARTITION BY model)),
candidates AS (
  SELECT model, score AS threshold, all_n - fp AS tn, fp, all_p - tp AS fn, tp FROM cumulated
  UNION ALL
  SELECT DISTINCT model, top + 2.220446049250313e-16::DOUBLE, all_n, 0, all_p, 0 FROM cumulated
  WHERE top + 2.220446049250313e-16::DOUBLE > top),
sweep AS (
  SELECT model, threshold, CAST(tn AS BIGINT) AS true_negatives, CAST(fp AS BIGINT) AS false_positives,
    CAST(fn AS BIGINT) AS false_negatives, CAST(tp AS BIGINT) AS true_positives,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM candidates),
best AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, false_positives, threshold DESC) AS k
  FROM sweep) WHERE k = 1)"""


def _rates(keys: str) -> str:
    return f"""counted AS (
      SELECT {keys}, count(*) FILTER (label = 0 AND score < 0.5) AS true_negatives,
        count(*) FILTER (label = 0 AND score >= 0.5) AS false_positives,
        count(*) FILTER (label = 1 AND score < 0.5) AS false_negatives,
        count(*) FILTER (label = 1 AND score >= 0.5) AS true_positives FROM scored GROUP BY ALL),
    rated AS (
      SELECT *, CASE WHEN true_positives + false_positives = 0 THEN 0 ELSE true_positives / (true_positives + false_positives)::DOUBLE END AS precision,
        CASE WHEN true_positives + false_negatives = 0 THEN 0 ELSE true_positives / (true_positives + false_negatives)::DOUBLE END AS recall,
        CASE WHEN 2 * true_positives + false_positives + false_negatives = 0 THEN 0 ELSE
          2.0::DOUBLE * true_positives / (2 * true_positives + false_positives + false_negatives) END AS f1,
        CASE WHEN root = 0 THEN 0 ELSE (true_positives::DOUBLE * true_negatives - false_positives::DOUBLE * false_negatives) / root END AS mcc
      FROM (SELECT *, sqrt((true_positives::DOUBLE + false_positives) * (true_positives + false_negatives)
        * (true_negatives + false_positives) * (true_negatives + false_negatives)) AS root FROM counted))"""


KINDS = sorted(audit.KINDS)
LEGACY = f"""ev AS (
  SELECT 'cap-0' || CASE WHEN event_id % 8 = 2 THEN 3 ELSE event_id % 8 END AS capture_id, event_id AS row,
    {US} * 1000 AS ts, user_id + CASE WHEN event_id % 11 = 0 THEN 10000 ELSE 0 END AS pid,
    CASE event_type WHEN 'view' THEN 'O' WHEN 'click' THEN 'C' WHEN 'purchase' THEN 'D' ELSE 'E' END AS kind,
    CAST(json_extract(props, '$.k') AS BIGINT) - 30 AS pattern FROM events),
man AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY capture_id) - 1 AS capture_index FROM (
    SELECT DISTINCT 'cap-0' || (event_id % 8) AS capture_id,
      CASE WHEN event_id % 8 < 4 THEN 'training' ELSE 'testing' END AS split FROM events)),
adj AS (SELECT *, pid + 10000 * capture_index AS adjusted_id FROM ev JOIN man USING (capture_id)),
per AS (
  SELECT *, (ts - arg_min(ts, capture_index * 1000000000 + row) OVER (PARTITION BY split)) // {HOUR} AS period FROM adj),
stat AS (
  SELECT split, adjusted_id, {", ".join(f"max(n{k}) AS {k}_max, CAST(sum(n{k}) AS BIGINT) AS {k}_sum" for k in KINDS)},
    CAST({" + ".join(f"max(p{k})" for k in KINDS)} AS BIGINT) AS P_max, CAST({" + ".join(f"sum(p{k})" for k in KINDS)} AS BIGINT) AS P_sum
  FROM (SELECT split, adjusted_id, period,
    {", ".join(f"count(*) FILTER (kind = '{k}') AS n{k}, coalesce(sum(pattern) FILTER (kind = '{k}'), 0) AS p{k}" for k in KINDS)}
    FROM per GROUP BY ALL) GROUP BY split, adjusted_id),
tri3 AS (
  SELECT split, adjusted_id, {", ".join(f"count(*) FILTER (g = '{g}') AS {g}" for g in audit.GRAMS)} FROM (
    SELECT split, adjusted_id, kind || lead(kind, 1) OVER q || lead(kind, 2) OVER q AS g FROM adj
    WINDOW q AS (PARTITION BY split, adjusted_id ORDER BY capture_index, row)) GROUP BY ALL),
wide AS (SELECT * FROM stat JOIN tri3 USING (split, adjusted_id)),
cells AS (
  SELECT split, adjusted_id AS pid, feature, value FROM wide UNPIVOT (value FOR feature IN ({", ".join(audit.COLUMNS)}))),
long_table AS (
  SELECT * FROM cells WHERE feature IN ('P_max', 'P_sum') OR (split, CASE WHEN feature LIKE '%_max' THEN left(feature, 1) || '_sum' ELSE feature END) IN (
    SELECT (split, feature) FROM cells WHERE feature NOT LIKE 'P%' GROUP BY split, feature HAVING max(value) > 0))"""

DIFF = """supplied AS (
  SELECT split, CASE WHEN pid % 41 = 3 THEN pid + 1000000 ELSE pid END AS pid, feature,
    value + CASE WHEN pid % 29 = 1 AND feature IN ('O_sum', 'OOO') THEN 1 ELSE 0 END AS value
  FROM long_table WHERE pid % 53 <> 7 AND feature <> 'EEE'),
diff AS (
  SELECT split, 'cell' AS kind, pid, feature, s.value AS supplied, r.value AS reconstructed
  FROM supplied s JOIN long_table r USING (split, pid, feature) WHERE s.value <> r.value
  UNION ALL SELECT split, 'missing_reconstructed_ids', pid, NULL, NULL, NULL FROM (
    SELECT split, pid FROM supplied EXCEPT SELECT split, pid FROM long_table)
  UNION ALL SELECT split, 'extra_reconstructed_ids', pid, NULL, NULL, NULL FROM (
    SELECT split, pid FROM long_table EXCEPT SELECT split, pid FROM supplied)
  UNION ALL SELECT split, 'extra_reconstructed_columns', NULL, feature, NULL, NULL FROM (
    SELECT split, feature FROM long_table EXCEPT SELECT split, feature FROM supplied)
  UNION ALL SELECT DISTINCT split, 'column_order_differs', NULL, NULL, NULL, NULL FROM long_table
    WHERE split = 'training' OR feature = 'EEE')"""

SHARED = """identities AS (SELECT DISTINCT split, capture_id, pid, adjusted_id FROM adj),
colliding AS (
  SELECT *, count(*) OVER (PARTITION BY split, adjusted_id) AS identities FROM identities)"""

LABEL_IDS = """label_ids AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'training' ELSE 'testing' END AS split, doc_id * 2 AS pid FROM labels),
joined AS (
  SELECT split, pid, CASE WHEN a AND b THEN 'matched' WHEN b THEN 'unmatched_label' ELSE 'unknown_feature_id' END AS status
  FROM (SELECT DISTINCT split, adjusted_id AS pid, true AS a FROM adj)
  FULL JOIN (SELECT DISTINCT split, pid, true AS b FROM label_ids) USING (split, pid)),
regression AS (
  SELECT split, CASE WHEN split = 'training' THEN 1 ELSE 0 END AS expected_matches, total AS expected_labels,
    coalesce(matched, 0) AS matched, total, coalesce(matched, 0) = CASE WHEN split = 'training' THEN 1 ELSE 0 END AS match
  FROM (SELECT split, count(*) AS total FROM label_ids GROUP BY 1)
  LEFT JOIN (SELECT split, count(*) FILTER (status = 'matched') AS matched FROM joined GROUP BY 1) USING (split))"""

FILES = """manifest AS (
  SELECT doc_id, 'logs/' || doc_id || '.csv' AS path, CASE WHEN doc_id % 13 = 0 THEN sha256('changed') ELSE sha256(text) END AS sha256,
    octet_length(encode(text)) + CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END AS size,
    CASE WHEN doc_id % 2 = 0 THEN 'training' ELSE 'testing' END AS split,
    CASE WHEN doc_id % 26 = 0 THEN sha256(text) END AS blob, octet_length(encode(text)) AS blob_size
  FROM documents WHERE doc_id % 19 <> 3),
found AS (
  SELECT 'logs/' || doc_id || '.csv' AS path, octet_length(encode(text)) AS actual_size, sha256(text) AS actual_sha256
  FROM documents WHERE doc_id % 17 <> 5),
inv AS (
  SELECT *, CASE WHEN actual_sha256 IS NULL THEN 'unavailable' WHEN frozen OR blobbed THEN 'match' ELSE 'mismatch' END AS status,
    CASE WHEN frozen THEN 'frozen_checkout' WHEN blobbed THEN 'git_blob' END AS byte_representation
  FROM (SELECT *, actual_sha256 = sha256 AND actual_size = size AS frozen,
    coalesce(actual_sha256 = blob AND actual_size = blob_size, false) AS blobbed FROM manifest LEFT JOIN found USING (path))),
shared AS (
  SELECT actual_sha256 AS sha256, split, path, CASE WHEN split = 'training' THEN n_test ELSE n_train END AS partners FROM inv
  JOIN (SELECT actual_sha256, count(*) FILTER (split = 'training') AS n_train, count(*) FILTER (split = 'testing') AS n_test
    FROM inv GROUP BY 1) USING (actual_sha256) WHERE n_train > 0 AND n_test > 0)"""

CHANGES = f"""base AS (
  SELECT {KEY}, start_ns + {DAY} AS end_ns, count(*) FILTER (op <> 'O') / 10.0::DOUBLE AS s, min(seq) AS alert_id,
    sha256('["' || run_id || '","' || boot_id || '",' || tgid || ',' || start_time_ns || ',' || start_ns || ','
      || (start_ns + {DAY}) || ',2]') AS window_id
  FROM (SELECT *, ts_ns - ts_ns % {DAY} AS start_ns FROM tel WHERE NOT is_exit AND result >= 0) GROUP BY ALL),
changes AS (
  SELECT *, CASE WHEN version = 3 AND tgid % 3 = 0 THEN NULL ELSE s + version / 100.0::DOUBLE END AS score,
    CASE WHEN version = 3 AND tgid % 3 = 0 THEN NULL ELSE s >= CASE WHEN version = 2 THEN 0.2 ELSE 0.1 END END AS suspicious
  FROM base, (SELECT unnest([1, 2, 3])::BIGINT AS version)),
lifecycle AS (
  SELECT window_id, arg_max(coalesce(suspicious, false), version) AS valid, arg_max(score, version) FILTER (suspicious) AS score,
    min(version) FILTER (suspicious) AS raised_version FROM changes GROUP BY 1 HAVING bool_or(coalesce(suspicious, false))),
now AS (SELECT * FROM changes WHERE version = 3)"""

def _manifest_violations() -> str:
    benign, scenarios = "idx < 5", ", ".join(f"'{name}'" for name in labelled.SCENARIOS)
    flags = [
        ("doc_id % 31 = 1", "manifest has another schema version than 1"),
        ("run_id IS NULL OR run_id = ''", "run_id is empty"),
        ("idx = 8", "scenario is not one of the planned ones"),
        ("seed IS NULL", "seed is no integer"),
        ("seed IS NULL OR run_id <> 'controlled-' || scenario || '-seed-' || seed", "run_id is not made of scenario and seed"),
        ("coalesce(seed, 77) = 77", "seed is not one of the planned ones"),
        ("split = 'later'", "split is none of training, validation, test"),
        ("coalesce(split <> CASE seed WHEN 41 THEN 'validation' WHEN 53 THEN 'test' WHEN 77 THEN 'none'"
         " ELSE 'training' END OR seed IS NULL, true)", "seed belongs to another split"),
        ("label = 'odd'", "behavior_label is neither benign nor suspicious"),
        (f"idx = 8 OR label <> CASE WHEN {benign} THEN 'benign' ELSE 'suspicious' END", "scenario has another behavior_label"),
        ("doc_id % 53 = 7", "label_provenance is not controlled_workload"),
        ("doc_id % 59 = 8", "status is not completed"),
        ("doc_id % 61 = 9", "workload_hold_seconds is not 50"),
        ("doc_id % 67 = 10", "background_activity is not unlabeled"),
        ("doc_id % 71 = 11", "process_scope_policy is not root_process_only"),
        ("doc_id % 73 = 12", "limits differ from the planned ones"),
        ("doc_id % 79 = 13", "number of tracked processes is not one"),
        ("doc_id % 89 = 15 OR doc_id % 83 = 14", "tracked process is not fully identified"),
        ("doc_id % 97 = 16 OR run_id IS NULL OR run_id = 'other'", "plan_sha256 is not that of the planned workload"),
    ]
    return f"""WITH base AS (
      SELECT doc_id, doc_id % 9 AS idx, list_extract([{scenarios}, 'unplanned'], CAST(doc_id % 9 AS INT) + 1) AS scenario,
        CASE WHEN doc_id % 37 <> 2 THEN list_extract([11, 23, 37, 41, 53, 77], CAST(doc_id % 6 AS INT) + 1) END AS seed,
        CASE WHEN doc_id % 41 = 5 THEN 'test' ELSE list_extract(['training', 'training', 'training', 'validation', 'test',
          'later'], CAST(doc_id % 6 AS INT) + 1) END AS split,
        CASE WHEN doc_id % 47 = 6 THEN 'odd' WHEN doc_id % 9 BETWEEN 5 AND 7 THEN 'suspicious' ELSE 'benign' END AS label
      FROM documents),
    named AS (SELECT *, CASE WHEN doc_id % 29 = 3 THEN 'other' WHEN doc_id % 43 = 4 THEN ''
        ELSE 'controlled-' || scenario || '-seed-' || seed END AS run_id FROM base)
    SELECT doc_id, concat_ws('; ', {", ".join(f"CASE WHEN {bad} THEN '{text}' END" for bad, text in flags)}) AS violations
    FROM named"""


STATEMENTS = {
    "successful_events": f"""{BASE} SELECT seq AS collector_sequence, tgid, ts_ns AS timestamp_ns, op AS operation,
        CAST(result AS BIGINT) AS result FROM ok""",
    "tumbling_assign": f"""{BASE} SELECT seq AS collector_sequence, tgid, start_ns, start_ns + {DAY} AS end_ns FROM ok""",
    "window_counts": f"{BASE}, {COUNTS} SELECT * FROM counts",
    "window_max_bucket": f"{BASE}, {PEAKS} SELECT * FROM peaks",
    "window_trigrams": f"{BASE}, {TRI} SELECT * FROM tri",
    "running_watermark": f"{BASE} SELECT run_id, pos, ts_ns AS timestamp_ns, w AS watermark_ns FROM mark",
    "late_counts": f"""{BASE}, {FIRST}, {LATE} SELECT {KEY}, late_event_count FROM late WHERE late_event_count > 0""",
    "exit_partial": f"""{BASE}, {FIRST}, {LATE} SELECT {KEY}, partial_by_exit, partial FROM late""",
    "loss_attribution": f"WITH {TEL}, {LOSS} SELECT * FROM loss",
    "window_quality": f"{WINDOWS} SELECT {KEY}, quality, complete, classifiable FROM full_windows",
    "window_ids": f"""{BASE} SELECT DISTINCT sha256('["' || run_id || '","' || boot_id || '",' || tgid || ','
        || start_time_ns || ',' || start_ns || ',' || (start_ns + {DAY}) || ',2]') AS window_id, tgid, start_ns FROM ok""",
    "feature_windows_full": f"{WINDOWS} SELECT * EXCLUDE (flags) FROM full_windows",
    "feature_values_long": f"""{WINDOWS} SELECT window_id, feature, value FROM (
        SELECT window_id, {", ".join(SUMS + MAXIMA + GRAMS)} FROM full_windows)
        UNPIVOT (value FOR feature IN ({", ".join(SUMS + MAXIMA + GRAMS)})) WHERE value > 0""",
    "rule_scores": f"""{WINDOWS}, {SCORED} SELECT window_id, run_id, model_version, score, threshold, suspicious,
        quality, supporting_features FROM scored""",
    "alerts": f"{WINDOWS}, {SCORED} SELECT window_id, run_id, score FROM scored WHERE suspicious",
    "run_verdicts": _verdicts(),
    "expected_bounds": f"""WITH {REC}, last AS (
        SELECT recording, slot, count(*) AS n, count(*) FILTER (pos = 3) AS third FROM rec GROUP BY ALL)
        SELECT recording, n + CASE WHEN slot IN (6, 8) THEN 1 ELSE 2 END AS records,
          CASE WHEN slot = 16 AND third > 0 THEN '{rules.ENVELOPE}' WHEN slot = 17 THEN '{rules.START_MATCH}'
            WHEN slot IN (9, 18) THEN '{rules.END_MATCH}' ELSE '' END AS violations FROM last""",
    "manifest_violations": _manifest_violations(),
    "foreign_windows": f"{WINDOWS} SELECT window_id, run_id FROM full_windows WHERE run_id = 'run-1'",
    "engine_violations": f"""WITH {TEL}, shifted AS (
        SELECT run_id, ts_ns, CASE WHEN pos % 101 = 0 THEN seq + 1 ELSE seq END AS collector_sequence FROM tel)
        SELECT run_id, collector_sequence, 'time lies before run start' AS violation
        FROM shifted WHERE ts_ns < {HOUR}
        UNION ALL SELECT run_id, collector_sequence, 'sequence number used twice' FROM shifted
        GROUP BY ALL HAVING count(*) > 1""",
    "health_running": f"""WITH {TEL} SELECT run_id, pos, row_number() OVER q AS records,
        CAST(row_number() OVER q AS DOUBLE) * 1000000000 / greatest(1, max(ts_ns) OVER q) AS event_rate,
        CAST(sum(lost) OVER q AS BIGINT) AS lost_events FROM tel WINDOW q AS (PARTITION BY run_id ORDER BY pos)""",
    "republished_state": f"""{WINDOWS}, {SCORED}, again AS (
        SELECT *, CASE WHEN run_id = 'run-1' THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END AS level FROM scored
        WHERE run_id = 'run-1' OR tgid % 3 <> 0)
        SELECT window_id, run_id, level AS threshold, score, score >= level AS suspicious,
        coalesce(score >= level, false) AS alert FROM again""",
    "run_summary": f"""{WINDOWS}, {SCORED} SELECT run_id, records, count(*) AS windows,
        count(*) FILTER (suspicious) AS alerts FROM scored
        JOIN (SELECT run_id, count(*) AS records FROM tel GROUP BY 1) USING (run_id) GROUP BY ALL""",
    "contract_violations": f"WITH {CONTRACT} SELECT recording, pos, violations FROM lines",
    "parsed_events": f"""WITH {CONTRACT} SELECT recording, n AS collector_sequence, 'run-' || (n % 5) AS run_id,
        ts_ns AS timestamp_ns, user_id + 1 AS tgid, 'O' AS operation,
        CAST(CASE WHEN n % 3 = 0 THEN NULL ELSE 0 END AS BIGINT) AS result,
        CASE WHEN n % 2 = 0 THEN 'YWI=' END AS filename_bytes_b64 FROM lines WHERE violations = ''""",
    "rejected_line_numbers": f"""WITH {CONTRACT}, numbered AS (
        SELECT *, row_number() OVER (PARTITION BY recording ORDER BY pos) AS line_number FROM lines)
        SELECT recording, line_number, split_part(violations, '; ', 1) AS violation FROM numbered WHERE violations <> ''""",
    "byte_budget": f"""WITH {RECORDS}, w AS (
        SELECT recording, pos, CAST(sum(octet_length(encode(value)) + 1) OVER (PARTITION BY recording ORDER BY pos) AS BIGINT)
          AS written_bytes FROM texts) SELECT *, written_bytes <= 100000 AS kept FROM w""",
    "canonical_records": f"WITH {RECORDS} SELECT recording, pos, sha256(value) AS line_digest FROM texts",
    "op_mapping": f"WITH {RAW} SELECT event_id, intent AS create_intent, op AS operation, ret >= 0 AS succeeded FROM mapped",
    "protocol_violations": "WITH " + RAW + " SELECT event_id, " + RAW_FLAGS.format(
        extra=", CASE WHEN event_id % 83 = 0 OR event_id % 79 = 0 THEN 'run_id has characters that are not allowed' END") + " AS violations FROM mapped",
    "contract_events": "WITH " + RAW + """ SELECT run_id, event_id + 1 AS collector_sequence, ts_ns AS timestamp_ns,
        user_id + 1 AS tgid, user_id + 1 AS tid, CASE WHEN NOT is_exit THEN op END AS operation,
        CASE WHEN NOT is_exit THEN ret END AS result, CASE WHEN NOT is_exit THEN to_base64(encode(props)) END AS filename_bytes_b64,
        CASE WHEN is_exit THEN 'process_exit' ELSE 'event' END AS type FROM mapped WHERE """ + RAW_FLAGS.format(extra="") + " = ''",
    "loss_deltas": f"""WITH {LOSSES}, stepped AS (
        SELECT run_id, pos, {", ".join(f"c{i} - coalesce(lag(c{i}) OVER q, 0) AS d{i}" for i in range(6))}
        FROM snap WINDOW q AS (PARTITION BY run_id ORDER BY pos))
        SELECT run_id, pos, {" + ".join(f"d{i}" for i in range(6))} AS lost_events,
          {" OR ".join(f"d{i} < 0" for i in range(6))} AS regressed FROM stepped""",
    "heartbeat_losses": f"""WITH {LOSSES}, stepped AS (
        SELECT run_id, pos, {", ".join(f"c{i} - coalesce(lag(c{i}) OVER q, 0) AS d{i}" for i in range(6))}
        FROM snap WINDOW q AS (PARTITION BY run_id ORDER BY pos)),
        tel AS (SELECT run_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS ts_ns,
          {" + ".join(f"d{i}" for i in range(6))} AS lost FROM stepped JOIN events ON event_id = pos
          WHERE NOT ({" OR ".join(f"d{i} < 0" for i in range(6))})), {LOSS}
        SELECT * FROM loss""",
    "counter_health": f"""WITH {LOSSES} SELECT run_id, pos, {" + ".join(f"c{i}" for i in range(6))} AS loss_total,
        {" + ".join(f"c{i}" for i in range(6))} = 0 AS telemetry_complete FROM snap""",
    "experiment_plan": f"""{BROKEN}, {PLAN} SELECT 'controlled-' || scenario || '-seed-' || seed AS run_id,
        CAST(seed AS BIGINT) AS seed, plan.split, behavior_label, scenario || ':seed=' || seed AS workload_identity,
        coalesce(n, 0) AS row_count FROM plan LEFT JOIN (SELECT doc_id % 40 AS k, count(*) AS n FROM rows GROUP BY 1)
        ON k = scenario_order * 5 + seed_order""",
    "tracked_windows": f"""{WINDOWS}, track AS (SELECT run_id AS r, max(tgid) AS t FROM tel WHERE NOT is_exit GROUP BY 1)
        SELECT window_id, run_id AS capture_id, sha256(run_id) AS capture_hash, 'training' AS split,
          CAST(CASE WHEN run_id = 'run-0' THEN 1 ELSE 0 END AS BIGINT) AS label,
          concat_ws(',', {", ".join(f"{name} || '.0'" for name in FEATURES)}) AS features, true AS complete, 'good' AS quality
        FROM full_windows JOIN track ON r = run_id AND tgid IN (t, t - 10) WHERE classifiable""",
    "recomputation_differences": f"""{BASE}, {COUNTS} SELECT * REPLACE (C_sum + 1 AS C_sum), 'supplied' AS found_in
        FROM counts WHERE tgid % 31 = 0 UNION ALL SELECT *, 'recomputed' FROM counts WHERE tgid % 31 = 0""",
    "set_completeness": """WITH p AS (SELECT 'd' || doc_id AS run_id FROM documents), a AS (SELECT 'd' || (doc_id + 2) AS run_id FROM labels)
        SELECT run_id, 'missing' AS status FROM (SELECT * FROM p EXCEPT SELECT * FROM a)
        UNION ALL SELECT run_id, 'unexpected' FROM (SELECT * FROM a EXCEPT SELECT * FROM p)""",
    "capture_consistency": f"""{BROKEN}
        SELECT capture_id, 'rows have another label or split than planned' AS violation FROM rows GROUP BY 1
          HAVING bool_or(label <> 1 OR split <> 'training')
        UNION ALL SELECT capture_id, 'rows of one capture have several hashes' FROM rows GROUP BY 1
          HAVING count(DISTINCT capture_hash) > 1
        UNION ALL SELECT DISTINCT capture_id, 'planned runs share one capture hash' FROM rows
          WHERE capture_hash IN (SELECT capture_hash FROM rows GROUP BY 1 HAVING count(DISTINCT capture_id) > 1)""",
    "row_violations": f"""{BROKEN}
        SELECT capture_id, window_id, 'window is incomplete or of poor quality' AS violation FROM rows WHERE row_quality <> 'good'
        UNION ALL SELECT capture_id, window_id, 'capture_hash is not 64 lower-case hex digits' FROM rows WHERE length(capture_hash) <> 64""",
    "leakage_violations": f"""{BROKEN}
        SELECT capture_id AS subject, 'capture lies in several splits' AS violation FROM rows GROUP BY 1 HAVING count(DISTINCT split) > 1
        UNION ALL SELECT capture_id, 'capture has several hashes' FROM rows GROUP BY 1 HAVING count(DISTINCT capture_hash) > 1
        UNION ALL SELECT capture_id, 'capture has several labels' FROM rows GROUP BY 1 HAVING count(DISTINCT label) > 1
        UNION ALL SELECT capture_hash, 'several captures have this hash' FROM rows GROUP BY 1
          HAVING count(DISTINCT capture_id) > 1
        UNION ALL SELECT window_id, 'window_id used twice' FROM rows GROUP BY 1 HAVING count(*) > 1""",
    "capture_summary": f"""{CLEAN} SELECT capture_id AS run_id, count(*) AS row_count, min(capture_hash) AS capture_sha256,
        CAST(min(label) AS BIGINT) AS label, min(split) AS split FROM rows GROUP BY 1""",
    "labelled_row_json": f"{CLEAN} SELECT doc_id, text FROM texts",
    "capture_content_hash": f"""{CLEAN} SELECT capture_id, count(*) AS row_count,
        sha256('[' || string_agg(text, ',' ORDER BY window_id) || ']') AS row_content_sha256 FROM texts GROUP BY 1""",
    "content_digest": f"{BROKEN}, {_digest('capture_id', 'texts')} SELECT * FROM digests",
    "role_projection": f"{CLEAN}, {ROLES} SELECT role, doc_id, split FROM roled",
    "role_totals": f"""{CLEAN}, {ROLES}, {_digest('role', 'roled')} SELECT role, row_count, splits, content_digest FROM digests
        JOIN (SELECT role, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM roled GROUP BY 1) USING (role)""",
    "manifest_diff": f"""{CLEAN}, caps AS (SELECT capture_id AS run_id FROM rows GROUP BY 1)
        SELECT run_id, CASE WHEN run_id = 'cap-1-3' THEN 'capture missing from manifest' ELSE 'differs in ' || concat_ws(',',
          CASE WHEN run_id LIKE '%-7' THEN 'row_count' END, CASE WHEN run_id LIKE '%-9' THEN 'split' END,
          CASE WHEN run_id LIKE '%-1_' THEN 'content_digest' END) END AS difference
        FROM caps WHERE run_id = 'cap-1-3' OR run_id LIKE '%-7' OR run_id LIKE '%-9' OR run_id LIKE '%-1_'
        UNION ALL SELECT 'cap-new', 'capture missing from dataset' FROM caps WHERE run_id = 'cap-1-3'""",
    "manifest_consistency": f"""{CLEAN}, caps AS (SELECT capture_id AS run_id, min(split) AS split FROM rows GROUP BY 1)
        SELECT run_id AS subject, 'entry has another label or split than planned' AS violation FROM caps
          WHERE run_id LIKE '%-5' OR (run_id LIKE '%-6' AND split <> 'test')
        UNION ALL SELECT run_id, 'capture_sha256 is not 64 lower-case hex digits' FROM caps WHERE run_id LIKE '%-4'
        UNION ALL SELECT 'zz', 'several entries have this capture hash' FROM caps WHERE run_id LIKE '%-4' HAVING count(*) > 1
        UNION ALL SELECT role, 'row_count differs from the sum of the entries' FROM (
          SELECT 'all' AS role FROM caps UNION SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'selection' END FROM caps)""",
    "plan_digest": f"""{CLEAN}, caps AS (SELECT capture_id AS run_id, max(split) AS split FROM rows GROUP BY 1)
        SELECT sha256('[' || string_agg('{{"run_id":"' || run_id || '","split":"' || split || '"}}', ',' ORDER BY run_id) || ']')
        AS plan_digest FROM caps""",
    "capture_acceptance": f"""WITH {REC}, {CAPTURES}, verdict AS ({_verdicts().replace("WITH " + REC + ", ", "WITH ", 1)})
        SELECT 'run-' || slot AS run_id, CASE WHEN slot NOT IN (6, 8) THEN end_ns - CASE WHEN slot = 9 THEN 1 ELSE 0 END END AS duration_ns,
          CASE WHEN slot <> 6 THEN v.records END AS record_count, CASE WHEN slot <> 6 THEN c.event_count END AS event_count,
          CASE WHEN slot <> 6 THEN c.heartbeat_count END AS heartbeat_count,
          CASE WHEN slot <> 6 THEN c.process_exit_count END AS process_exit_count, n_events AS tracked_event_count,
          CASE WHEN all_text = '' THEN 'accepted' ELSE 'rejected' END AS status, all_text AS violations
        FROM (SELECT *, concat_ws('; ',
            CASE WHEN slot = 14 THEN 'run is not planned' END,
            CASE WHEN slot IN (13, 14) THEN 'manifest and plan differ for this run' END,
            CASE WHEN slot = 6 THEN 'no recording for this run' END,
            CASE WHEN slot = 6 THEN 'recording holds no valid telemetry' END,
            CASE WHEN slot IN (6, 7) THEN 'run was not recorded live' END,
            CASE WHEN slot IN (6, 8, 14, 15) THEN 'recording is shorter or longer than planned' END,
            CASE WHEN n_events < 1 THEN 'no event of any tracked process' END,
            CASE WHEN n_exits < 1 THEN 'a tracked process has no exit' END,
            CASE WHEN slot <> 6 THEN nullif(violations, '') END) AS all_text
          FROM cand JOIN tracked USING (slot) JOIN (SELECT recording, records, violations FROM verdict) USING (recording)) c
        JOIN (SELECT recording, records FROM verdict) v USING (recording)""",
    "selection_guard": f"""{CLEAN} SELECT 'rows of the test split are present' AS violation FROM rows
        WHERE split = 'test' HAVING count(*) > 0
        UNION ALL SELECT 'a label has fewer than 3 training captures' FROM rows WHERE split = 'training'
        HAVING count(DISTINCT capture_id) FILTER (label = 0) < 3 OR count(DISTINCT capture_id) FILTER (label = 1) < 3""",
    "fold_assignment": f"""{CLEAN}, caps AS (SELECT capture_id, CAST(max(label) AS BIGINT) AS label, count(*) AS n FROM rows GROUP BY 1)
        SELECT *, (row_number() OVER (PARTITION BY label ORDER BY n DESC, md5(capture_id || ':37'), capture_id) - 1) % 3 AS fold FROM caps""",
    "threshold_sweep": f"{CLEAN}, {SCORES}, {SWEEP} SELECT * FROM sweep",
    "best_threshold": f"{CLEAN}, {SCORES}, {SWEEP} SELECT * FROM best",
    "confusion_metrics": f"{CLEAN}, {SCORES}, {_rates('model')} SELECT * EXCLUDE (root) FROM rated",
    "finalist": f"""{CLEAN}, {SCORES}, {SWEEP} SELECT *, CAST(CASE model WHEN 'rule' THEN 0 WHEN 'rbf_svm' THEN 1 ELSE 2 END AS BIGINT) AS complexity
        FROM best ORDER BY f1 DESC, false_positives, complexity LIMIT 1""",
    "metric_disagreements": f"""{CLEAN}, {SCORES}, {_rates('capture_id, model')} SELECT capture_id, model,
        'recall' || CASE WHEN model = 'rule' THEN ',mcc' ELSE '' END AS disagrees FROM rated WHERE capture_id LIKE '%-2'""",
    "legacy_adjusted": f"WITH {LEGACY} SELECT split, capture_index, row, adjusted_id FROM adj",
    "legacy_periods": f"WITH {LEGACY} SELECT split, row, adjusted_id, CAST(period AS BIGINT) AS period FROM per",
    "legacy_statistics": f"WITH {LEGACY} SELECT * FROM stat",
    "legacy_trigrams": f"WITH {LEGACY} SELECT * FROM tri3",
    "legacy_long": f"WITH {LEGACY} SELECT * FROM long_table",
    "legacy_wide": f"""WITH {LEGACY} SELECT adjusted_id AS PID, {", ".join(audit.COLUMNS)} FROM wide WHERE split = 'training'""",
    "legacy_wide_testing": f"""WITH {LEGACY} SELECT adjusted_id AS PID, {", ".join(audit.COLUMNS)} FROM wide WHERE split = 'testing'""",
    "legacy_captures": f"""WITH {LEGACY}, stepped AS (
        SELECT *, lag(ts) OVER (PARTITION BY capture_id ORDER BY row) AS earlier FROM adj)
        SELECT man.split, capture_id, 10000 * capture_index AS offset, coalesce(events, 0) AS events,
          coalesce(encryption_events, 0) AS encryption_events, coalesce(timestamp_regressions, 0) AS timestamp_regressions,
          coalesce(recorded_ids, 0) AS recorded_ids, lowest_id, highest_id
        FROM man LEFT JOIN (SELECT capture_id, count(*) AS events, count(*) FILTER (kind = 'E') AS encryption_events,
          count(*) FILTER (ts < earlier) AS timestamp_regressions, count(DISTINCT pid) AS recorded_ids,
          min(pid) AS lowest_id, max(pid) AS highest_id FROM stepped GROUP BY 1) USING (capture_id)""",
    "id_collisions": f"""WITH {LEGACY}, {SHARED} SELECT split, adjusted_id, capture_id, pid AS recorded_id, identities
        FROM colliding WHERE identities > 1""",
    "label_join": f"WITH {LEGACY}, {LABEL_IDS} SELECT split, pid, status FROM joined",
    "label_regression": f"WITH {LEGACY}, {LABEL_IDS} SELECT * REPLACE (CAST(expected_matches AS BIGINT) AS expected_matches) FROM regression",
    "feature_diff": f"WITH {LEGACY}, {DIFF} SELECT * FROM diff",
    "inventory_status": f"WITH {FILES} SELECT path, status, byte_representation FROM inv",
    "verification_status": f"""WITH {FILES} SELECT path, CASE WHEN actual_size IS NULL THEN 'missing' WHEN actual_size <> size THEN 'mismatch'
        WHEN actual_sha256 = sha256 THEN 'match' ELSE 'mismatch' END AS status, sha256 AS expected_sha256,
        CASE WHEN actual_size = size THEN actual_sha256 END AS actual_sha256 FROM inv""",
    "unlisted_files": f"WITH {FILES} SELECT path FROM found WHERE path NOT IN (SELECT path FROM manifest)",
    "overlap": f"WITH {FILES} SELECT * FROM shared",
    "audit_verdict": f"""WITH {LEGACY}, {LABEL_IDS}, {DIFF}, {SHARED}, {FILES}, c AS (SELECT
        (SELECT count(*) FROM inv WHERE status <> 'match') AS input_mismatches,
        (SELECT count(*) FROM found WHERE path NOT IN (SELECT path FROM manifest)) AS unmanifested_files,
        (SELECT count(*) FROM regression WHERE NOT match) AS label_regressions, (SELECT count(*) FROM diff) AS feature_differences,
        (SELECT count(*) FROM shared) AS overlapping_captures, (SELECT count(*) FROM colliding WHERE identities > 1) AS colliding_identities)
        SELECT *, input_mismatches + unmanifested_files + label_regressions + feature_differences + overlapping_captures
          + colliding_identities = 0 AS ok FROM c""",
    "list_runs": f"""WITH {RECORDS} SELECT run_id, source, started_ns, status FROM (
        SELECT recording, max(run_id) AS run_id, min(ts_ns) AS started_ns, max(source) AS source, max(status) AS status
        FROM all_records GROUP BY 1) ORDER BY started_ns DESC, run_id LIMIT 10 OFFSET 3""",
    "process_windows": f"""{BASE}, {COUNTS} SELECT run_id, boot_id, tgid, start_time_ns, count(*) AS window_count,
        max(start_ns) AS latest_window_ns FROM counts GROUP BY ALL""",
    "list_processes": f"""{BASE}, {COUNTS} SELECT run_id, boot_id, tgid, start_time_ns, count(*) AS window_count,
        max(start_ns) AS latest_window_ns FROM counts GROUP BY ALL
        ORDER BY latest_window_ns DESC, tgid, run_id, boot_id, start_time_ns LIMIT 100 OFFSET 5""",
    "list_windows": f"""{WINDOWS}, {SCORED} SELECT s.window_id, s.run_id, s.tgid, s.start_time_ns, s.start_ns, s.end_ns, s.quality,
        s.classifiable, model_version, score, threshold, suspicious,
        concat_ws(',', {", ".join(f"'{name}=' || {name}" for name in sorted(FEATURES))}) AS features
        FROM scored s JOIN full_windows w USING (window_id) ORDER BY s.start_ns DESC, s.window_id LIMIT 100 OFFSET 20""",
    "alert_lifecycle": f"WITH {TEL}, {CHANGES} SELECT * FROM lifecycle",
    "latest_predictions": f"WITH {TEL}, {CHANGES} SELECT window_id, version, score, suspicious FROM now",
    "list_alerts": f"""WITH {TEL}, {CHANGES} SELECT alert_id, window_id, run_id, tgid, start_time_ns, l.score, l.valid
        FROM lifecycle l JOIN base USING (window_id) ORDER BY alert_id DESC LIMIT 100 OFFSET 10""",
    "current_predictions": f"""{WINDOWS}, {SCORED} SELECT window_id, CASE WHEN keep THEN score END AS score,
        CASE WHEN keep THEN suspicious END AS suspicious, quality
        FROM (SELECT *, classifiable AND tgid % 4 <> 0 AS keep FROM scored)""",
    "metrics": f"""WITH {TEL}, {CHANGES} SELECT (SELECT count(*) FROM now) AS windows,
        (SELECT count(*) FROM now WHERE suspicious) AS suspicious_windows, (SELECT count(*) FROM lifecycle WHERE valid) AS active_alerts""",
    "integrity_violations": f"""WITH {TEL}, {CHANGES}, w AS (SELECT * FROM now WHERE tgid % 17 <> 2),
        p AS (SELECT window_id, tgid FROM now WHERE tgid % 13 <> 1 UNION ALL SELECT window_id, tgid FROM now WHERE tgid % 13 <> 1 AND tgid % 19 = 3)
        SELECT 'window without run' AS violation, window_id AS key FROM w WHERE run_id = 'run-1'
        UNION ALL SELECT 'prediction does not match its window', window_id FROM p WHERE tgid % 17 = 2
        UNION ALL SELECT 'window without prediction', window_id FROM w WHERE tgid % 13 = 1
        UNION ALL SELECT 'window predicted more than once', window_id FROM p GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'alert without window', window_id FROM now WHERE suspicious AND tgid % 17 = 2""",
    "final_health": f"""WITH verdict AS ({_verdicts()}) SELECT recording, false AS connected, 0.0::DOUBLE AS event_rate,
        observed_loss AS lost_events, nullif(split_part(violations, '; ', 1), '') AS error FROM verdict""",
    "health_snapshot": f"""WITH {TEL}, h AS (SELECT run_id, pos, row_number() OVER q AS records, max(ts_ns) OVER q AS m,
          CAST(sum(lost) OVER q AS BIGINT) AS lost_events FROM tel WINDOW q AS (PARTITION BY run_id ORDER BY pos))
        SELECT run_id, true AS collector_connected, CAST(arg_max(records, pos) AS DOUBLE) * 1000000000 / greatest(1, arg_max(m, pos)) AS event_rate,
          arg_max(lost_events, pos) AS lost_events, true AS recording FROM h GROUP BY 1""",
    "ingest_runs": f"""
WITH {TEL},
cut AS (SELECT max(pos) + 1 AS n FROM tel),
dealt AS (
  SELECT run_id, tgid > 0 AS good, ts_ns, lost, (pos >= n // 5)::INT + (pos >= 2 * n // 5)::INT + (pos >= 3 * n // 5)::INT
    + (pos >= 4 * n // 5)::INT AS batch_id FROM tel, cut),
news AS (
  -- A process id of 0 breaks the contract: such records do not count and mark their run.
  SELECT run_id, batch_id, count(*) FILTER (good) AS n, max(ts_ns) FILTER (good) AS last_ns,
    coalesce(sum(lost) FILTER (good), 0) AS lost, bool_or(NOT good) AS bad FROM dealt GROUP BY ALL
  UNION ALL SELECT DISTINCT run_id, unnest([1, 5]), 0, 0, 0, false FROM tel),
grown AS (
  SELECT DISTINCT run_id, batch_id,
    CAST(sum(n) OVER w AS BIGINT) AS records, max(last_ns) OVER w AS last_ns, CAST(sum(lost) OVER w AS BIGINT) AS lost_events,
    bool_or(bad) OVER w AS bad
  FROM news WINDOW w AS (PARTITION BY run_id ORDER BY batch_id))
SELECT CAST(batch_id AS BIGINT) AS batch_id, run_id, records,
  CASE WHEN batch_id = 5 THEN 0.0 WHEN batch_id >= 1 THEN records * 1e9 / greatest(last_ns, 1) END AS event_rate,
  lost_events, batch_id < 5 AS connected, batch_id < 5 AS recording,
  CASE WHEN bad THEN 'a record breaks the contract' END AS error
FROM grown""",
    "capture_rows": """
SELECT 'capture-' || CASE WHEN event_id % 6 = 5 THEN 'last' ELSE CAST(event_id % 6 AS VARCHAR) END || '.csv' AS path,
  8 * (event_id + 1) AS row, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS ts, user_id AS pid,
  CASE event_type WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' WHEN 'error' THEN 'E' ELSE 'O' END AS kind, event_id % 5 AS pattern
FROM events WHERE event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 107 <> 0 AND event_id % 109 <> 0 AND event_id % 113 <> 0""",
    "capture_file_violations": """
WITH e AS (
  SELECT event_id AS n, 'capture-' || CASE WHEN event_id % 6 = 5 THEN 'last' ELSE CAST(event_id % 6 AS VARCHAR) END || '.csv' AS path
  FROM events),
wrong AS (
  SELECT *, CASE WHEN n % 109 = 0 THEN 'malformed row width' WHEN n % 113 = 0 THEN 'malformed quoting'
                 WHEN n % 101 = 0 THEN 'malformed row width' END AS broken FROM e)
SELECT path, 8 * (n + 1) AS row, broken AS violation FROM wrong WHERE broken IS NOT NULL
UNION ALL SELECT path, 8 * (n + 1), 'expected a nonnegative 64-bit integer' FROM wrong WHERE broken IS NULL AND n % 107 = 0
UNION ALL SELECT path, 8 * (n + 1), 'unknown event type' FROM wrong
  WHERE (broken IS NULL OR (n % 109 <> 0 AND n % 113 <> 0)) AND n % 103 = 0
UNION ALL SELECT DISTINCT path, 0, 'unexpected capture schema' FROM e WHERE path = 'capture-last.csv'""",
    "feature_file_violations": """
WITH c AS (
  SELECT c_custkey AS n, 'features-' || CASE WHEN c_custkey % 4 = 3 THEN 'last' ELSE CAST(c_custkey % 4 AS VARCHAR) END || '.csv' AS path,
    CASE WHEN c_custkey % 17 = 0 THEN 17 ELSE c_custkey END AS pid,
    CASE WHEN c_custkey % 19 = 0 OR c_custkey % 13 = 0 THEN 'malformed row width'
         WHEN c_custkey % 11 = 0 THEN 'expected a nonnegative 64-bit integer' END AS broken FROM customer)
SELECT path, 8 * (n + 1) AS row, broken AS violation FROM c WHERE broken IS NOT NULL
UNION ALL SELECT path, 8 * (n + 1), 'duplicate identifier' FROM (
  SELECT *, count(*) OVER (PARTITION BY path, pid) AS uses FROM c WHERE broken IS NULL) WHERE uses > 1
UNION ALL SELECT DISTINCT path, 0, 'unexpected feature schema' FROM c WHERE path = 'features-last.csv'""",
    "feature_file_cells": """
WITH c AS (
  SELECT c_custkey AS n, 'features-' || CASE WHEN c_custkey % 4 = 3 THEN 'last' ELSE CAST(c_custkey % 4 AS VARCHAR) END || '.csv' AS path,
    CASE WHEN c_custkey % 17 = 0 THEN 17 ELSE c_custkey END AS pid FROM customer
  WHERE c_custkey % 19 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 11 <> 0)
SELECT path, pid, 1::BIGINT AS position, 'C_max' AS feature, n % 7 AS value FROM c
UNION ALL SELECT path, pid, 2, 'C_sum', n % 5 FROM c
UNION ALL SELECT path, pid, 3, CASE WHEN path = 'features-last.csv' THEN 'oox' ELSE 'OOO' END, 2 FROM c""",
    "label_file_violations": """
WITH s AS (
  SELECT s_suppkey AS n, 'labels-' || CASE WHEN s_suppkey % 3 = 2 THEN 'last' ELSE CAST(s_suppkey % 3 AS VARCHAR) END || '.csv' AS path,
    CASE WHEN s_suppkey % 11 = 0 AND s_suppkey % 7 <> 0 THEN 11 ELSE s_suppkey END AS pid,
    CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 3 = 2 THEN 'malformed row width'
         WHEN s_suppkey % 7 = 0 THEN 'expected a nonnegative 64-bit integer' END AS broken FROM supplier)
SELECT path, 8 * (n + 1) AS row, broken AS violation FROM s WHERE broken IS NOT NULL
UNION ALL SELECT path, 8 * (n + 1), 'duplicate identifier' FROM (
  SELECT *, count(*) OVER (PARTITION BY path, pid) AS uses FROM s WHERE broken IS NULL) WHERE uses > 1
UNION ALL SELECT DISTINCT path, 0, 'empty schema or duplicate columns' FROM s WHERE path = 'labels-last.csv'""",
    "deep_pages": f"""{WINDOWS}, placed AS (
  SELECT window_id, run_id, tgid, start_ns, O_sum, C_sum, D_sum,
    row_number() OVER (ORDER BY start_ns DESC, window_id) - 1 AS position, count(*) OVER () AS n FROM full_windows),
asked AS (SELECT unnest([0, 1, 2, 3]) AS page),
offsets AS (
  SELECT DISTINCT page, n, CASE page WHEN 0 THEN 0 WHEN 1 THEN n // 2 WHEN 2 THEN greatest(0, n - 30) ELSE n END AS low
  FROM asked, placed),
pages AS (
  SELECT page, low, least(low + 100, n) AS high FROM offsets
  UNION ALL SELECT page + 10, least(low + 100, n), least(low + 120, n) FROM offsets WHERE low < n)
SELECT window_id, run_id, tgid, start_ns, O_sum, C_sum, D_sum, position, page::BIGINT AS page
FROM placed JOIN pages ON position >= low AND position < high""",
    "collector_violations": """
SELECT * FROM (
  SELECT 'rec-' || user_id % 5 AS recording, event_id AS pos,
    CASE WHEN event_id % 31 = 0 THEN 'invalid JSON' WHEN event_id % 37 = 0 THEN 'line is no JSON object'
         WHEN event_id % 53 = 0 THEN 'blank JSONL record' WHEN event_id % 41 = 0 THEN 'unknown record type'
         ELSE concat_ws('; ', CASE WHEN event_id % 43 = 0 THEN 'record has a field that is not known' END,
           CASE WHEN event_id % 83 = 0 THEN 'run_id is no text or empty' END,
           CASE WHEN event_id % 47 = 0 AND event_id % 43 <> 0 THEN 'tid is no integer from 1 to 2^32 - 1' END) END AS violations
  FROM events) WHERE violations <> ''""",
    "dataset_changes": f"""{CLEAN}, sides AS (
  SELECT capture_id, 'before' AS side, sha256(text) AS d FROM texts
  UNION ALL SELECT capture_id, 'after',
    sha256(CASE WHEN doc_id % 97 = 5 THEN replace(text, '"quality":"good"', '"quality":"other"') ELSE text END) FROM texts),
parts AS (
  SELECT capture_id, side, substr(d, 1, 6) AS prefix, count(*) AS n, string_agg(d, ',' ORDER BY d) AS content FROM sides GROUP BY ALL)
SELECT coalesce(b.capture_id, a.capture_id) AS capture_id, coalesce(b.prefix, a.prefix) AS prefix, b.n AS rows_before, a.n AS rows_after
FROM (FROM parts WHERE side = 'before') b FULL JOIN (FROM parts WHERE side = 'after') a
  ON a.capture_id = b.capture_id AND a.prefix = b.prefix WHERE a.content IS DISTINCT FROM b.content""",
    "dataset_contract": f"""{CLEAN}, {ROLES}, caps AS (SELECT DISTINCT capture_id AS run_id FROM rows)
SELECT run_id AS subject, 'capture missing from manifest' AS violation FROM caps WHERE run_id = 'cap-1-3'
UNION ALL SELECT role, 'role differs in ' || CASE role WHEN 'test' THEN 'row_count,splits,content_digest' ELSE 'splits' END
  FROM (SELECT DISTINCT role FROM roled)
UNION ALL SELECT 'manifest', unnest(['feature_version is not the known one', 'feature names or their order differ'])
UNION ALL SELECT 'manifest', 'plan digest differs' FROM caps WHERE run_id = 'cap-0-2'
UNION ALL SELECT 'manifest', 'number of captures differs from entries or plan' FROM (
  SELECT count(*) FILTER (run_id <> 'cap-1-3') AS a, count(*) FILTER (run_id <> 'cap-0-2') AS b FROM caps) WHERE a <> 3 OR b <> 3""",
    "file_manifest_violations": """
WITH d AS (
  SELECT doc_id AS n, lang, n_chars, CASE WHEN doc_id % 11 = 0 THEN '../' WHEN doc_id % 13 = 0 THEN '/' WHEN doc_id % 17 = 0 THEN 'a/../'
    ELSE 'a..b/' END || doc_id AS path FROM documents),
langs AS (SELECT DISTINCT lang, CASE WHEN lang = 'fr' THEN 'http' ELSE 'https' END || '://example.invalid/' || lang AS repository FROM d)
SELECT repository AS subject, 'schema_version is not the known one' AS violation FROM langs WHERE lang = 'de'
UNION ALL SELECT repository, 'repository is no https address' FROM langs WHERE lang = 'fr' OR lang IS NULL
UNION ALL SELECT repository, 'commit is not 40 hex digits' FROM langs WHERE lang = 'es' OR lang IS NULL
UNION ALL SELECT path, 'path leaves the checkout' FROM d WHERE path NOT LIKE 'a..b/%'
UNION ALL SELECT path, 'sha256 is not 64 hex digits' FROM d WHERE n % 23 = 0
UNION ALL SELECT path, 'size is no number from 0 up' FROM d WHERE n % 29 = 0 OR n % 31 = 0""",
    "unequal_totals": f"""{CLEAN}, n AS (SELECT capture_id, count(*) AS n FROM rows GROUP BY 1)
SELECT capture_id, n AS fewest, n + CASE WHEN capture_id LIKE '%-2' THEN 2 ELSE 0 END AS most FROM n
WHERE capture_id LIKE '%-2' OR capture_id LIKE '%-3'""",
}
STATEMENTS["stream_windows"] = STATEMENTS["feature_windows_full"]
STATEMENTS["stream_windows_batches"] = STATEMENTS["feature_windows_full"]
