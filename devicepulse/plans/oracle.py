"""Check SQL for the registered queries, in the dialect of DuckDB.

Written from the definitions of the results, not from the Spark plans: quantiles
use the built-in function, the ROC area a window over all scores, and so on.
"""

from __future__ import annotations

from devicepulse import schema as S
from devicepulse.plans.queries import (
    LINEAR,
    LINEAR_INTERCEPT,
    LINEITEM_NUMBERS,
    LINEITEM_WEIGHTS,
    LONG_DOCUMENT,
    RULE_MODELS,
)
from devicepulse.plans.readings import DIRTY, REQUEST


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def r6(sql: str) -> str:
    return f"round({sql}, 6) + {dbl(0.0)}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _word(column: str, j: int) -> str:
    return f"CAST(('0x' || substr({column}, {1 + 4 * j}, 4)) AS BIGINT)"


SCORE = " + ".join(
    f"{dbl(w)} * (CAST({c} AS DOUBLE) / {dbl(s)})" for c, (w, s) in S.RISK_WEIGHTS.items()
)
VIEW = f"""
WITH hashed AS (
  SELECT event_id, user_id, ts,
         md5(concat('a', CAST(event_id AS VARCHAR))) AS ha,
         md5(concat('b', CAST(event_id AS VARCHAR))) AS hb
  FROM events),
words AS (
  SELECT event_id, user_id, ts,
         {', '.join(f"{_word('ha', j)} AS u{j}" for j in range(8))},
         {_word('hb', 0)} AS u8, {_word('hb', 1)} AS u9
  FROM hashed),
drawn AS (
  SELECT event_id AS Reading_ID,
         'DEV-' || CASE WHEN user_id + 1 > 99999 THEN CAST(user_id + 1 AS VARCHAR)
                        ELSE lpad(CAST(user_id + 1 AS VARCHAR), 5, '0') END AS Device_ID,
         ts AS Reading_TS,
         CASE WHEN u0 % 2 = 0 THEN 'Router' ELSE 'Switch' END AS Device_Type,
         CAST(1000 + u1 % 9001 AS DOUBLE) / 100 AS CPU_Usage,
         CAST(2000 + u2 % 8001 AS DOUBLE) / 100 AS Memory_Usage,
         CAST(2500 + u3 % 6501 AS DOUBLE) / 100 AS Temperature,
         CAST(100 + (u4 * 2) % 99901 AS DOUBLE) / 100 AS Uptime,
         CAST(CASE WHEN u5 < 62000 THEN 10 + u5 % 21 ELSE 80 + u5 % 300 END AS INT)
           AS Interface_Errors,
         CAST(u6 % 1001 AS DOUBLE) / 100 AS Packet_Loss,
         CAST(1000 + u7 % 9001 AS DOUBLE) / 100 AS Bandwidth_Usage,
         CAST(CASE WHEN u8 < 62000 THEN u8 % 11 ELSE 12 + u8 % 17 END AS INT) AS Log_Errors,
         (CAST(u9 AS DOUBLE) / 65535 - {dbl(0.5)}) * {dbl(0.1732)} AS noise
  FROM words),
scored AS (SELECT *, {SCORE} AS Risk_Score FROM drawn),
r AS (
  SELECT * EXCLUDE (noise),
         CAST(CASE WHEN Risk_Score + noise > {dbl(0.65)} THEN 1 ELSE 0 END AS INT) AS Failed
  FROM scored)
"""

PROB = "least(greatest(Risk_Score, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"


def band_of(p: str) -> str:
    return (
        f"CASE WHEN {p} < {dbl(S.LOW_BELOW)} THEN 'LOW' WHEN {p} < {dbl(S.HIGH_FROM)} "
        "THEN 'MEDIUM' ELSE 'HIGH' END"
    )


def band_column(risk: str, i: int) -> str:
    cases = " ".join(f"WHEN {text(band[0])} THEN {text(band[i])}" for band in S.BANDS)
    return f"CASE {risk} {cases} END"


def advisory_list(say: dict[str, str]) -> str:
    fired = ", ".join(
        f"CASE WHEN {c} > {limit} THEN {text(say[key])} END" for key, c, limit in S.ADVISORY_RULES
    )
    return f"coalesce(nullif(concat_ws('|', {fired}), ''), {text(say[S.NO_ADVISORY])})"


ADVISORY_KEYS = advisory_list({k: k for k in S.ADVISORY_TEXTS})


def summary(by: str | None) -> str:
    pick, group = (f"{by},", f"GROUP BY {by}") if by else ("", "")
    return f"""{VIEW}
SELECT {pick} TRUE AS success, count(*) AS total_devices,
       CAST(coalesce(sum(Failed), 0) AS BIGINT) AS failed_count,
       CAST(count(*) - coalesce(sum(Failed), 0) AS BIGINT) AS healthy_count,
       round(100 * CAST(count(*) - sum(Failed) AS DOUBLE) / count(*), 2) AS health_rate,
       round(avg(CPU_Usage), 2) AS avg_cpu, round(avg(Memory_Usage), 2) AS avg_mem,
       round(avg(Temperature), 2) AS avg_temp, round(avg(Packet_Loss), 2) AS avg_loss,
       count(*) FILTER (Device_Type = 'Router') AS routers_count,
       count(*) FILTER (Device_Type = 'Switch') AS switches_count,
       'None (Model not trained)' AS active_model
FROM r {group}"""


def _checks() -> str:
    parts = ["CASE WHEN Device_Type NOT IN ('Router', 'Switch') THEN 'bad:Device_Type' END"]
    for c, (low, high) in S.INPUT_RANGES.items():
        over = f" OR {c} > {high}" if high is not None else ""
        parts.append(f"CASE WHEN {c} IS NULL THEN 'missing:{c}' END")
        parts.append(f"CASE WHEN {c} < {low}{over} THEN 'out_of_range:{c}' END")
    return f"concat_ws('|', {', '.join(parts)})"


DIRTY_ROWS = f"{VIEW}, dirty AS (SELECT Reading_ID, {DIRTY} FROM r)"
DIRTY_TYPES = {
    "Reading_ID": "bigint",
    "Device_Type": "string",
    **{c: "int" if c in S.COUNTERS else "double" for c in S.NUMERIC_FEATURES},
}


def _column_info() -> str:
    rows = [
        f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS non_null, "
        f"'{kind}' AS dtype FROM dirty"
        for i, (c, kind) in enumerate(DIRTY_TYPES.items())
    ]
    return f"{DIRTY_ROWS} " + " UNION ALL ".join(rows)


def missing(cte: str, source: str, cols: list[str]) -> str:
    rows = [
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM {source}" for c in cols
    ]
    return f"{cte} " + " UNION ALL ".join(rows)


def _decoded() -> str:
    fields, bad = [], [
        "CASE WHEN NOT is_object THEN 'malformed_json' END",
        "CASE WHEN is_object AND NOT usable THEN 'empty_request' END",
    ]
    for c in S.NUMERIC_FEATURES:
        kind = "BIGINT" if c in S.COUNTERS else "DOUBLE"
        path = f"'$.{c}'"
        raw = f"trim(json_extract_string(request, {path}))"
        number = f"TRY_CAST({raw} AS DOUBLE)"
        if kind == "BIGINT":
            number = (
                f"CASE WHEN json_type(request, {path}) = 'VARCHAR' AND NOT "
                f"regexp_full_match({raw}, '[+-]?[0-9]+') THEN NULL ELSE trunc({number}) END"
            )
        value = f"CASE WHEN json_type(request, {path}) IS NULL THEN 0 ELSE {number} END"
        fields.append(f"CASE WHEN usable THEN CAST({value} AS {kind}) END AS {c}")
        bad.append(f"CASE WHEN usable AND ({value}) IS NULL THEN 'not_a_number:{c}' END")
    given = "json_extract_string(request, '$.Device_Type')"
    return f"""{VIEW},
requests AS (SELECT Reading_ID, {REQUEST} AS request FROM r),
valid AS (
  SELECT Reading_ID, CASE WHEN json_valid(request) THEN request ELSE 'null' END AS request
  FROM requests),
kinds AS (
  SELECT *, json_type(request) = 'OBJECT' AS is_object,
         json_type(request) = 'OBJECT' AND len(json_keys(request)) > 0 AS usable
  FROM valid)
SELECT Reading_ID,
       CASE WHEN usable THEN
         CASE WHEN json_type(request, '$.Device_Type') IS NULL
                OR lower(trim({given})) = 'router' THEN 'Router' ELSE 'Switch' END
       END AS Device_Type,
       {', '.join(fields)},
       concat_ws('|', {', '.join(bad)}) AS reasons
FROM kinds"""


def _defaults() -> str:
    def field(c):
        return (
            f"CASE WHEN Reading_ID % 5 IN (0, 1, 2) THEN {text(str(S.FORM_DEFAULTS[c]))} "
            f"ELSE CAST({c} AS VARCHAR) END"
        )

    cols = [
        f"CAST({field(c)} AS {'BIGINT' if c in S.COUNTERS else 'DOUBLE'}) AS {c}"
        for c in S.NUMERIC_FEATURES
    ]
    return (
        f"{VIEW} SELECT Reading_ID, {field('Device_Type')} AS Device_Type, {', '.join(cols)} FROM r"
    )


def described(cte: str, source: str, cols: list[str]) -> str:
    def quartile(c, p):
        return r6(f"quantile_cont(CAST({c} AS DOUBLE), {p})")

    rows = [
        f"""SELECT '{c}' AS "column", count({c}) AS "count", {r6(f'avg({c})')} AS mean,
        {r6(f'stddev_samp({c})')} AS std, CAST(min({c}) AS DOUBLE) AS "min",
        {quartile(c, 0.25)} AS q25, {quartile(c, 0.5)} AS q50, {quartile(c, 0.75)} AS q75,
        CAST(max({c}) AS DOUBLE) AS "max" FROM {source}"""
        for c in cols
    ]
    return f"{cte} " + " UNION ALL ".join(rows)


def correlations(cte: str, source: str, cols: list[str]) -> str:
    rows = [
        f"SELECT '{x}' AS x, '{y}' AS y, "
        f"{r6(f'corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))')} AS corr FROM {source}"
        for x in cols
        for y in cols
    ]
    return f"{cte} " + " UNION ALL ".join(rows)


def boxes(cte: str, source: str, group: str, col: str) -> str:
    lead = f"{cte}," if cte else "WITH"
    return f"""{lead}
v AS (SELECT {group} AS g, CAST({col} AS DOUBLE) AS v FROM {source}
      WHERE {group} IS NOT NULL AND {col} IS NOT NULL),
q AS (SELECT g, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
             quantile_cont(v, 0.75) AS q75 FROM v GROUP BY g),
f AS (SELECT *, q25 - {dbl(1.5)} * (q75 - q25) AS lo, q75 + {dbl(1.5)} * (q75 - q25) AS hi FROM q)
SELECT g AS {group}, '{col}' AS "column", count(*) AS n,
       {r6('q25')} AS q25, {r6('q50')} AS q50, {r6('q75')} AS q75,
       {r6('least(min(v) FILTER (v >= lo AND v <= hi), q25)')} AS low_whisker,
       {r6('greatest(max(v) FILTER (v >= lo AND v <= hi), q75)')} AS high_whisker,
       count(*) FILTER (v < lo OR v > hi) AS outliers
FROM v JOIN f USING (g) GROUP BY g, q25, q50, q75"""


OUTLIERS = f"""{VIEW},
q AS (SELECT Failed, quantile_cont(CAST(Interface_Errors AS DOUBLE), 0.25) AS a,
             quantile_cont(CAST(Interface_Errors AS DOUBLE), 0.75) AS b FROM r GROUP BY Failed),
f AS (SELECT Failed, a - {dbl(1.5)} * (b - a) AS lo, b + {dbl(1.5)} * (b - a) AS hi FROM q)
SELECT Reading_ID, Failed, Interface_Errors, {r6('lo')} AS low_fence, {r6('hi')} AS high_fence
FROM r JOIN f USING (Failed) WHERE Interface_Errors < lo OR Interface_Errors > hi"""

PREDICTIONS = f"{VIEW}, p AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS model, Failed AS label, "
    f"CASE WHEN Risk_Score > {dbl(t)} THEN 1 ELSE 0 END AS prediction, {PROB} AS probability FROM r"
    for name, t in RULE_MODELS.items()
) + f""" ),
cells AS (
  SELECT model, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
         count(*) FILTER (label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (label = 0 AND prediction = 0) AS tn
  FROM p GROUP BY model),
metrics AS (
  SELECT model, {r6('(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)')} AS accuracy,
         {r6('coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0)')} AS "precision",
         {r6('coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0)')} AS recall,
         {r6('coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0)')} AS f1
  FROM cells),
ranks AS (
  SELECT model, label, rank() OVER w + (count(*) OVER (PARTITION BY model, probability) - 1) / 2.0
         AS place
  FROM p WINDOW w AS (PARTITION BY model ORDER BY probability)),
sides AS (
  SELECT model, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS np,
         CAST(count(*) FILTER (label = 0) AS DOUBLE) AS nn,
         CAST(sum(place) FILTER (label = 1) AS DOUBLE) AS places
  FROM ranks GROUP BY model),
auc AS (
  SELECT model, {r6('(places - np * (np + 1) / 2) / nullif(np * nn, 0)')} AS roc_auc FROM sides),
board AS (SELECT metrics.*, roc_auc FROM metrics JOIN auc USING (model))
"""

def report(threshold: float) -> str:
    return f"""{VIEW},
p AS (SELECT Failed AS y, CASE WHEN Risk_Score > {dbl(threshold)} THEN 1 ELSE 0 END AS z FROM r),
c AS (
  SELECT k AS class, CAST(count(*) FILTER (y = k AND z = k) AS DOUBLE) AS hit,
         count(*) FILTER (y = k) AS support, count(*) FILTER (z = k) AS claimed
  FROM p, (VALUES (0), (1)) AS classes(k) GROUP BY k),
m AS (
  SELECT CAST(class AS VARCHAR) AS class, coalesce(hit / nullif(claimed, 0), 0) AS pr,
         coalesce(hit / nullif(support, 0), 0) AS re,
         coalesce(2 * hit / nullif(support + claimed, 0), 0) AS f, support, hit
  FROM c)
SELECT class, {r6('pr')} AS "precision", {r6('re')} AS recall, {r6('f')} AS f1, support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, {r6('sum(hit) / sum(support)')},
  CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', {r6('avg(pr)')}, {r6('avg(re)')}, {r6('avg(f)')},
  CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', {r6('sum(pr * support) / sum(support)')},
  {r6('sum(re * support) / sum(support)')}, {r6('sum(f * support) / sum(support)')},
  CAST(sum(support) AS BIGINT) FROM m"""


def sides(cte: str, source: str, key: str, label: str) -> str:
    lead = f"{cte}," if cte else "WITH"
    return f"""{lead}
placed AS (
  SELECT {key}, {label}, count(*) OVER (PARTITION BY {label}) AS n,
         row_number() OVER (PARTITION BY {label}
                            ORDER BY md5(concat('42:', CAST({key} AS VARCHAR)))) AS place
  FROM {source}),
sides AS (
  SELECT {key}, {label},
         CASE WHEN place <= round({dbl(0.2)} * n) THEN 'test' ELSE 'train' END AS side
  FROM placed)"""


def side_counts(cte: str, source: str, key: str, label: str) -> str:
    return (
        f"{sides(cte, source, key, label)} SELECT {label}, "
        "count(*) FILTER (side = 'train') AS n_train, count(*) FILTER (side = 'test') AS n_test "
        f"FROM sides GROUP BY {label}"
    )


def weights(cte: str, source: str, label: str) -> str:
    lead = f"{cte}," if cte else "WITH"
    return (
        f"{lead} c AS (SELECT {label}, count(*) AS n FROM {source} WHERE {label} IS NOT NULL "
        f"GROUP BY {label}) SELECT {label}, n, "
        f"{r6('CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n)')} "
        "AS weight FROM c"
    )


Z_STATS = ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in S.NUMERIC_FEATURES
)
Z = {c: f"(({c} - m_{c}) / s_{c})" for c in S.NUMERIC_FEATURES}
Z_FROM = f"{VIEW}, stats AS (SELECT {Z_STATS} FROM r)"
LOGIT = " + ".join([dbl(LINEAR_INTERCEPT), *[f"{dbl(w)} * {Z[c]}" for c, w in LINEAR.items()]])

LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINEITEM_NUMBERS, "l_returnflag",
    "l_linestatus", "l_shipdate",
]

LINE_SCORE = " + ".join(
    f"{dbl(w)} * ({c} / {dbl(s)})" for c, (w, s) in LINEITEM_WEIGHTS.items()
)
LINE_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINEITEM_NUMBERS)
LONG_DOCUMENTS = f"""
WITH p AS (
  SELECT lang, quality AS y, CAST(n_chars > {LONG_DOCUMENT} AS INT) AS z, n_chars
  FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
cells AS (
  SELECT lang, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (y = z) AS hits,
         CAST(count(*) FILTER (y = 1 AND z = 1) AS DOUBLE) AS tp,
         count(*) FILTER (z = 1) AS claimed, count(*) FILTER (y = 1) AS positives
  FROM p GROUP BY lang),
pairs AS (
  SELECT a.lang, avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0
                          WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END) AS area
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang)"""

def _answers() -> str:
    """Per request the fields of its response."""
    told = {
        "success": "TRUE",
        "prediction": f"CAST(Risk_Score > {dbl(0.65)} AS INT)",
        "probability": r6("p"),
        "risk": "risk",
        "risk_color": band_column("risk", 1),
        "status_text": band_column("risk", 2),
        "advisory": advisory_list(S.ADVISORY_TEXTS),
        "model_used": "'Risk Score'",
    }
    fields = ", ".join(f"CASE WHEN reasons = '' THEN {sql} END AS {c}" for c, sql in told.items())
    return f"""
WITH decoded AS ({_decoded()}),
s AS (SELECT *, {SCORE} AS Risk_Score FROM decoded),
b AS (SELECT *, {PROB} AS p, {band_of(PROB)} AS risk FROM s)
SELECT Reading_ID, {fields}, nullif(replace(reasons, '|', ', '), '') AS error FROM b"""


BURSTS = """WITH e AS (
  SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT event_id, user_id, ts FROM e WHERE nxt IS NULL OR nxt - ts > INTERVAL 30 MINUTE"""

ORACLE = {
    "fleet_summary": summary(None),
    "fleet_by_type": summary("Device_Type"),
    "fleet_by_device": summary("Device_ID"),
    "risk_score": f"{VIEW} SELECT Reading_ID, {r6(SCORE)} AS score FROM r",
    "threshold_label": f"{VIEW} SELECT Reading_ID, "
    f"CAST({SCORE} > {dbl(0.65)} AS INT) AS label FROM r",
    "feature_projection": f"{VIEW} SELECT {', '.join(S.FEATURES)}, Failed FROM r",
    "rounded_measurements": f"{VIEW} SELECT Reading_ID, "
    + ", ".join(f"round({c} / 3, 2) AS {c}" for c in S.MEASUREMENTS)
    + " FROM r",
    "risk_band": f"{VIEW} SELECT Reading_ID, {band_of(PROB)} AS risk FROM r",
    "band_details": f"{VIEW}, b AS (SELECT Reading_ID, {band_of(PROB)} AS risk FROM r) "
    f"SELECT *, {band_column('risk', 1)} AS risk_color, {band_column('risk', 2)} AS status_text, "
    f"{band_column('risk', 3)} AS action_text FROM b",
    "advisories": f"{VIEW} SELECT Reading_ID, {ADVISORY_KEYS} AS advisory FROM r",
    "advisory_counts": f"{VIEW} "
    + " UNION ALL ".join(
        f"SELECT '{key}' AS advisory, count(*) FILTER ({c} > {limit}) AS n FROM r"
        for key, c, limit in S.ADVISORY_RULES
    )
    + f" UNION ALL SELECT 'none', count(*) FILTER ({ADVISORY_KEYS} = 'none') FROM r",
    "validation_report": f"{DIRTY_ROWS} SELECT Reading_ID, CAST({_checks()} = '' AS INT) AS valid, "
    f"{_checks()} AS reasons FROM dirty",
    "decode_requests": _decoded(),
    "normalize_type": f"""{VIEW}, g AS (
  SELECT Reading_ID, CASE Reading_ID % 6 WHEN 0 THEN 'router' WHEN 1 THEN 'switch'
         WHEN 2 THEN 'firewall' WHEN 3 THEN NULL ELSE lower(Device_Type) END AS t FROM r)
SELECT Reading_ID, CASE WHEN t = 'router' THEN 'Router' ELSE 'Switch' END AS lenient,
       CASE t WHEN 'router' THEN 'Router' WHEN 'switch' THEN 'Switch' END AS strict FROM g""",
    "apply_defaults": _defaults(),
    "device_ids": """SELECT event_id, printf('DEV-%05d', user_id + 1) AS device,
       printf('DEV-%05d', event_id * 1000 + 1) AS wide FROM events""",
    "head": f"{VIEW} SELECT * FROM r ORDER BY Reading_ID LIMIT 5",
    "riskiest_devices": f"""{VIEW} SELECT Reading_ID, Device_ID, {r6('Risk_Score')} AS Risk_Score
FROM r ORDER BY 3 DESC, 1 LIMIT 20""",
    "shape": f"{VIEW} SELECT count(*) AS n_rows, CAST(11 AS INT) AS n_columns FROM r",
    "missing_counts": missing(DIRTY_ROWS, "dirty", list(DIRTY_TYPES)),
    "column_info": _column_info(),
    "describe": described(VIEW, "r", [*S.NUMERIC_FEATURES, "Failed"]),
    "failure_distribution": f"{VIEW} SELECT Failed, count(*) AS n FROM r GROUP BY 1",
    "type_breakdown": f"{VIEW} SELECT Device_Type, count(*) AS n FROM r GROUP BY 1",
    "correlation_matrix": correlations(VIEW, "r", [*S.NUMERIC_FEATURES, "Failed"]),
    "box_stats_cpu": boxes(VIEW, "r", "Failed", "CPU_Usage"),
    "box_stats_memory": boxes(VIEW, "r", "Failed", "Memory_Usage"),
    "box_stats_temperature": boxes(VIEW, "r", "Failed", "Temperature"),
    "box_outliers": OUTLIERS,
    "confusion": f"{PREDICTIONS} SELECT * FROM cells",
    "binary_metrics": f"{PREDICTIONS} SELECT * FROM metrics",
    "roc_auc": f"{PREDICTIONS} SELECT roc_auc FROM auc WHERE model = 'random rule'",
    "classification_report": report(0.65),
    "classification_report_by_model": " UNION ALL ".join(
        f"SELECT '{name}' AS model, * FROM ({report(t)})" for name, t in RULE_MODELS.items()
    ),
    "leaderboard": f"{PREDICTIONS} SELECT * FROM board",
    "leaderboard_status": f"""{PREDICTIONS} SELECT model, f1,
       CASE WHEN model = 'random rule' THEN 'ACTIVE MODEL' ELSE 'CANDIDATE' END AS status
FROM board""",
    "best_model": f"{PREDICTIONS} SELECT * FROM board WHERE f1 > 0 ORDER BY f1 DESC LIMIT 1",
    "stratified_split": f"{sides(VIEW, 'r', 'Reading_ID', 'Failed')} SELECT * FROM sides",
    "split_counts": side_counts(VIEW, "r", "Reading_ID", "Failed"),
    "split_counts_labels": side_counts("", "labels", "doc_id", "quality"),
    "class_weights": weights(VIEW, "r", "Failed"),
    "class_weights_labels": weights("", "labels", "toxic"),
    "standardized": f"{Z_FROM} SELECT Reading_ID, "
    + ", ".join(f"{r6(z)} AS z_{c}" for c, z in Z.items())
    + " FROM r, stats",
    "one_hot": f"""{VIEW} SELECT Reading_ID, Device_Type,
       CAST(Device_Type = 'Switch' AS INT) AS Device_Type_Switch FROM r""",
    "linear_score": f"{Z_FROM} SELECT Reading_ID, {r6(f'1 / (1 + exp(-({LOGIT})))')} "
    "AS probability FROM r, stats",
    "rule_scoring": f"""{VIEW}, b AS (SELECT *, {PROB} AS p, {band_of(PROB)} AS risk FROM r)
SELECT Reading_ID, Device_ID, CAST(Risk_Score > {dbl(0.65)} AS INT) AS prediction,
       {r6('p')} AS probability, risk, {band_column('risk', 1)} AS risk_color,
       {band_column('risk', 2)} AS status_text, {band_column('risk', 3)} AS action_text,
       {advisory_list(S.ADVISORY_TEXTS)} AS advisory, 'Risk Score' AS model_used FROM b""",
    "encode_responses": f"""{VIEW}, b AS (SELECT *, {PROB} AS p, {band_of(PROB)} AS risk FROM r)
SELECT Reading_ID, TRUE AS success, CAST(Risk_Score > {dbl(0.65)} AS INT) AS prediction,
       {r6('p')} AS probability, risk, {band_column('risk', 1)} AS risk_color,
       {band_column('risk', 2)} AS status_text, {advisory_list(S.ADVISORY_TEXTS)} AS advisory,
       'Risk Score' AS model_used FROM b""",
    "fleet_summary_json": summary(None),
    "sql_functions": f"""{VIEW} SELECT Reading_ID, {r6(SCORE)} AS score,
       CAST({SCORE} > {dbl(0.65)} AS INT) AS label, {band_of(f'({SCORE})')} AS band,
       Device_Type AS kind FROM r""",
    "debounce": BURSTS,
    "quiet_stream": BURSTS,
    "scoring_stream": _answers(),
    "quarantine_stream": f"{DIRTY_ROWS} SELECT Reading_ID, CASE WHEN {_checks()} = '' THEN 'accepted' "
    f"ELSE 'rejected' END AS side, {_checks()} AS reasons FROM dirty",
    "feature_vector": f"{VIEW}, stats AS (SELECT {Z_STATS.replace('stddev_pop', 'stddev_samp')} FROM r) "
    "SELECT Reading_ID, "
    + ", ".join(f"{r6(z)} AS z_{c}" for c, z in Z.items())
    + f", {r6("CAST(Device_Type = 'Switch' AS DOUBLE)")} AS is_switch FROM r, stats",
    "telemetry_files": missing(
        f"{VIEW}, dirty AS (SELECT Device_ID, {DIRTY}, Failed FROM r)",
        "dirty",
        S.TELEMETRY.fieldNames(),
    ),
    "summary_stream": summary("Device_Type"),
    "incremental_summary": summary("Device_Type"),
    "percent_text": f"{VIEW} SELECT Reading_ID, printf('%.2f%%', Interface_Errors / 700 * 100) AS percent FROM r",
    "thousands_text": "SELECT event_id, format('{:,}', event_id * 12345 - 1000000) AS thousands FROM events",
    "request_errors": f"SELECT error, count(*) AS n FROM ({_answers()}) WHERE error IS NOT NULL GROUP BY 1",
    "describe_lineitem": described("", "lineitem", LINEITEM_NUMBERS),
    "missing_counts_lineitem": missing("", "lineitem", LINEITEM_COLUMNS),
    "value_counts_events": "SELECT event_type, count(*) AS n FROM events "
    "WHERE event_type IS NOT NULL GROUP BY 1",
    "correlation_lineitem": correlations("", "lineitem", LINEITEM_NUMBERS),
    "box_stats_lineitem": boxes("", "lineitem", "l_returnflag", "l_extendedprice"),
    "box_stats_events": boxes("", "events", "event_type", "value"),
    "risk_score_lineitem": f"""SELECT l_orderkey, l_linenumber, {r6(LINE_SCORE)} AS score,
       CAST({LINE_SCORE} > {dbl(0.5)} AS INT) AS label,
       {band_of(f'least(greatest({LINE_SCORE}, {dbl(0.0)}), {dbl(1.0)})')} AS band FROM lineitem""",
    "standardized_lineitem": f"WITH stats AS (SELECT {LINE_STATS} FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{r6(f'(({c} - m_{c}) / s_{c})')} AS z_{c}" for c in LINEITEM_NUMBERS)
    + " FROM lineitem, stats",
    "one_hot_lineitem": """SELECT l_orderkey, l_linenumber, l_returnflag,
       CAST(l_returnflag = 'N' AS INT) AS l_returnflag_N,
       CAST(l_returnflag = 'R' AS INT) AS l_returnflag_R FROM lineitem""",
    "binary_metrics_documents": f"""{LONG_DOCUMENTS}
SELECT lang, {r6('hits / n')} AS accuracy, {r6('coalesce(tp / nullif(claimed, 0), 0)')} AS "precision",
       {r6('coalesce(tp / nullif(positives, 0), 0)')} AS recall,
       {r6('coalesce(2 * tp / nullif(claimed + positives, 0), 0)')} AS f1 FROM cells""",
    "roc_auc_documents": f"""{LONG_DOCUMENTS}
SELECT lang, {r6('area')} AS roc_auc FROM cells LEFT JOIN pairs USING (lang)""",
    "train_compare": f"""{sides(VIEW, 'r', 'Reading_ID', 'Failed')},
m AS (SELECT unnest(['Logistic Regression', 'Random Forest', 'Gradient Boosted Trees']) AS model)
SELECT model, count(*) AS n, count(*) FILTER (Failed = 1) AS positives, TRUE AS reaches_floors
FROM m, sides WHERE side = 'test' GROUP BY model""",
    "fleet_scoring": f"""{VIEW} SELECT Reading_ID, {advisory_list(S.ADVISORY_TEXTS)} AS advisory,
       TRUE AS band_agrees, TRUE AS class_agrees FROM r""",
}
