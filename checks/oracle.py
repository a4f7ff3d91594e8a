"""ANSI SQL for each registered query, on the same tables.

Written as plain window SQL on whole tables, without the block scan, the
array content or the samples' helper columns of the engine.
"""

from __future__ import annotations

DAY = 86_400_000
SIZE = 4 * DAY
SLOT = SIZE // 4

# watermark delay and allowed lateness of each policy
POLICIES = {"sw": (0, 0), "dww": (DAY, 0), "alw": (0, DAY), "cbw": (0, DAY)}
MODES = {"sw": "FAST", "dww": "DELAYED", "alw": "BASELINE", "cbw": "PROPOSED"}
L1, L2, L3 = "Spänning L1", "Spänning L2", "Spänning L3"
THREE_LABEL = "Spänning L1/L2/L3"
NO_MORE_INPUT = 9223372036854775807

READINGS = f"""
raw AS (
  SELECT event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS arrival_s,
    CAST(user_id AS VARCHAR) AS meter_id,
    CASE WHEN user_id % 3 = 0 THEN 'THREE' ELSE 'SINGLE' END AS meter_phase,
    CASE WHEN event_type IN ('error', 'click') THEN '{L1}'
         WHEN event_type IN ('view', 'purchase') THEN '{L2}' ELSE '{L3}' END AS series_id,
    CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS k, value
  FROM events),
readings AS (
  SELECT event_id AS arrival_seq, arrival_s // 86400 AS arrival_epoch, meter_id, series_id,
    (arrival_s - 60 * ((k * k * k * 2880) // 1000000)) * 1000 AS event_ms, value,
    arrival_s * 1000 AS insert_ms,
    CASE WHEN meter_phase = 'THREE' OR series_id = '{L1}' THEN meter_phase END AS phase_group
  FROM raw)"""

SEEN = f"""{READINGS},
seen AS (
  SELECT *, max(event_ms) OVER (ORDER BY arrival_seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_seen_ms,
    event_ms - ((event_ms % {SIZE}) + {SIZE}) % {SIZE} AS window_start_ms
  FROM readings)"""


def text_of(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%d %H:%M:%S')"


def placed(name: str, alias: str = "placed") -> str:
    delay, lateness = POLICIES[name]
    return f"""
{alias} AS (
  SELECT *, window_start_ms + {SIZE} AS window_end_ms,
    coalesce(max_seen_ms - {delay} >= window_start_ms + {SIZE}, false) AS late,
    coalesce(max_seen_ms - {delay} >= window_start_ms + {SIZE} + {lateness}, false) AS dropped,
    CASE series_id WHEN '{L1}' THEN 0 WHEN '{L2}' THEN 1 ELSE 2 END AS phase
  FROM seen WHERE phase_group IS NOT NULL)"""


GROUP = "phase_group, meter_id, window_start_ms, window_end_ms"


def passes(shift: int, alias: str, windows: str) -> str:
    return f"""
{alias} AS (
  SELECT w.window_end_ms, min(r.arrival_seq) AS pass_seq,
    arg_min(r.event_ms, r.arrival_seq) AS pass_event_ms
  FROM (SELECT DISTINCT window_end_ms FROM {windows}) w
  JOIN readings r ON r.event_ms >= w.window_end_ms + {shift} GROUP BY 1)"""


def content(steps: str, ranked: str, p: str) -> str:
    """Fault flag, slots and text of each step from its first k points."""
    return f"""
{p}points AS (
  SELECT s.phase_group, s.meter_id, s.window_start_ms, s.k, r.phase, r.event_ms, r.arrival_seq,
    r.value, CASE WHEN abs(r.value) <= 50 THEN '0' ELSE '1' END AS mark
  FROM (SELECT DISTINCT phase_group, meter_id, window_start_ms, k FROM {steps}) s JOIN {ranked} r
    ON r.phase_group = s.phase_group AND r.meter_id = s.meter_id
   AND r.window_start_ms = s.window_start_ms AND r.rn <= s.k),
{p}by_phase AS (
  SELECT phase_group, meter_id, window_start_ms, k, phase,
    contains(string_agg(mark, '' ORDER BY event_ms, arrival_seq), '000') AS zeros,
    string_agg(printf('%.3f', value), ';' ORDER BY event_ms, arrival_seq) AS txt
  FROM {p}points GROUP BY phase_group, meter_id, window_start_ms, k, phase),
{p}content AS (
  SELECT phase_group, meter_id, window_start_ms, k,
    CASE WHEN phase_group = 'THREE' THEN count(*) FILTER (WHERE zeros) = 3
         ELSE bool_or(zeros AND phase = 0) END AS fault_indicator,
    '{L1}=[' || coalesce(max(txt) FILTER (WHERE phase = 0), '') || ']' || CASE WHEN phase_group = 'THREE' THEN
      '|{L2}=[' || coalesce(max(txt) FILTER (WHERE phase = 1), '') || ']|{L3}=['
      || coalesce(max(txt) FILTER (WHERE phase = 2), '') || ']' ELSE '' END AS all_text
  FROM {p}by_phase GROUP BY phase_group, meter_id, window_start_ms, k),
{p}slots AS (
  SELECT phase_group, meter_id, window_start_ms, k, count(DISTINCT
      CASE WHEN phase_group = 'THREE' THEN ((event_ms - window_start_ms) // {SLOT}) * 3 + phase
           ELSE (event_ms - window_start_ms) // {SLOT} END) AS slots
  FROM {p}points GROUP BY phase_group, meter_id, window_start_ms, k)"""


def native(name: str, p: str = "") -> str:
    delay, _ = POLICIES[name]
    return f"""{placed(name, p + 'placed')},
{p}ranked AS (
  SELECT *, row_number() OVER w AS rn, count(*) FILTER (WHERE NOT late) OVER
      (PARTITION BY phase_group, meter_id, window_start_ms) AS on_time
  FROM {p}placed WHERE NOT dropped
  WINDOW w AS (PARTITION BY phase_group, meter_id, window_start_ms ORDER BY arrival_seq)),
{p}steps AS (
  SELECT {GROUP}, rn AS k, arrival_seq AS by_seq, false AS closes FROM {p}ranked WHERE late
  UNION ALL SELECT {GROUP}, on_time, NULL, true FROM {p}ranked WHERE rn = 1 AND on_time > 0),
{passes(delay, p + 'passes', p + 'placed')},{content(p + 'steps', p + 'ranked', p)},
{p}emissions AS (
  SELECT '{MODES[name]}' AS mode, s.phase_group, s.meter_id,
    CASE WHEN s.phase_group = 'THREE' THEN '{THREE_LABEL}' ELSE '{L1}' END AS series_id,
    s.window_start_ms, s.window_end_ms,
    CAST(row_number() OVER (PARTITION BY s.phase_group, s.meter_id, s.window_start_ms ORDER BY s.k) AS INTEGER) AS emit_no,
    CASE WHEN closes THEN coalesce(pass_seq, {NO_MORE_INPUT}) ELSE by_seq END AS fire_seq,
    CASE WHEN closes THEN 1 ELSE 0 END AS fire_phase,
    CAST(s.k AS INTEGER) AS count, 'NATIVE' AS result_type, CAST(NULL AS VARCHAR) AS finalization_reason,
    '' AS completeness, fault_indicator, CAST(NULL AS INTEGER) AS distinct_slot_count,
    CASE WHEN fault_indicator THEN all_text END AS voltage_data,
    CAST(NULL AS BIGINT) AS watermark_at_purge_ms, CAST(NULL AS BIGINT) AS allowed_lateness_ms,
    CAST(NULL AS BIGINT) AS finalization_latency_ms, CAST(NULL AS BIGINT) AS latency_reduction_ms
  FROM {p}steps s JOIN {p}content c USING (phase_group, meter_id, window_start_ms, k)
  LEFT JOIN {p}passes USING (window_end_ms))"""


def completeness(p: str = "") -> str:
    lateness = POLICIES["cbw"][1]
    latency = f"greatest(0, least({lateness}, coalesce(watermark, window_end_ms) - window_end_ms))"
    return f"""{placed('cbw', p + 'placed')},
{p}ranked AS (
  SELECT *, row_number() OVER w AS rn, CASE WHEN phase_group = 'THREE' THEN 12 ELSE 4 END AS full_count,
    CASE WHEN phase_group = 'THREE' THEN 9 ELSE 3 END AS first_count
  FROM {p}placed WHERE NOT dropped
  WINDOW w AS (PARTITION BY phase_group, meter_id, window_start_ms ORDER BY arrival_seq)),
{p}windows AS (
  SELECT {GROUP}, full_count, first_count, max(rn) AS taken FROM {p}ranked GROUP BY ALL),
{p}steps AS (
  SELECT {GROUP}, rn AS k, 'PRELIMINARY' AS why, arrival_seq AS by_seq, max_seen_ms, full_count
    FROM {p}ranked WHERE rn = first_count
  UNION ALL SELECT {GROUP}, rn, 'COMPLETENESS', arrival_seq, max_seen_ms, full_count
    FROM {p}ranked WHERE rn = full_count
  UNION ALL SELECT {GROUP}, taken, 'DEADLINE', NULL, NULL, full_count
    FROM {p}windows WHERE taken < full_count),
{passes(lateness, p + 'passes', p + 'placed')},{content(p + 'steps', p + 'ranked', p)},
{p}fired AS (
  SELECT s.*, CASE WHEN why = 'DEADLINE' THEN coalesce(pass_seq, {NO_MORE_INPUT}) ELSE by_seq END AS fire_seq,
    CASE WHEN why = 'DEADLINE' THEN coalesce(pass_event_ms - 1, {NO_MORE_INPUT}) ELSE max_seen_ms - 1 END AS watermark
  FROM {p}steps s LEFT JOIN {p}passes USING (window_end_ms)),
{p}emissions AS (
  SELECT 'PROPOSED' AS mode, s.phase_group, s.meter_id,
    CASE WHEN s.phase_group = 'THREE' THEN '{THREE_LABEL}' ELSE '{L1}' END AS series_id,
    s.window_start_ms, s.window_end_ms,
    CAST(row_number() OVER (PARTITION BY s.phase_group, s.meter_id, s.window_start_ms
      ORDER BY CASE WHEN why = 'PRELIMINARY' THEN 0 ELSE 1 END) AS INTEGER) AS emit_no,
    fire_seq, CASE WHEN why = 'DEADLINE' THEN 1 ELSE 0 END AS fire_phase, CAST(s.k AS INTEGER) AS count,
    CASE WHEN why = 'PRELIMINARY' THEN why ELSE 'FINAL' END AS result_type, why AS finalization_reason,
    printf('%.1f%%', CAST(s.k AS DOUBLE) / full_count * 100) AS completeness,
    fault_indicator, CAST(slots AS INTEGER) AS distinct_slot_count,
    CASE WHEN fault_indicator THEN all_text END AS voltage_data,
    CASE WHEN why <> 'PRELIMINARY' THEN watermark END AS watermark_at_purge_ms,
    CASE WHEN why <> 'PRELIMINARY' THEN CAST({lateness} AS BIGINT) END AS allowed_lateness_ms,
    CASE WHEN why <> 'PRELIMINARY' THEN CAST({latency} AS BIGINT) END AS finalization_latency_ms,
    CASE WHEN why <> 'PRELIMINARY' THEN CAST({lateness} - {latency} AS BIGINT) END AS latency_reduction_ms
  FROM {p}fired s JOIN {p}content c USING (phase_group, meter_id, window_start_ms, k)
  JOIN {p}slots USING (phase_group, meter_id, window_start_ms, k))"""


def emissions(name: str, p: str = "") -> str:
    return completeness(p) if name == "cbw" else native(name, p)


KEY = "mode, meter_id, series_id, window_start_ms, window_end_ms"


def counts(source: str, alias: str) -> str:
    early = """result_type = 'FINAL' AND mode = 'PROPOSED' AND allowed_lateness_ms > 0
      AND finalization_latency_ms < allowed_lateness_ms"""
    return f"""
{alias} AS (
  SELECT {KEY}, CAST(count(*) AS INTEGER) AS output_count,
    bool_or(coalesce({early}, false)) AS early_purged_raw,
    bool_or(coalesce({early} AND finalization_reason = 'COMPLETENESS', false)) AS early_purged,
    arg_max(count, emit_no) AS final_count, max(distinct_slot_count) AS distinct_slot_count
  FROM {source} GROUP BY ALL)"""


def all_counts(*names: str) -> str:
    """Output counts of several policies as ``counted`` with their experiment."""
    parts = [f"{emissions(n, n + '_')},{counts(n + '_emissions', n + '_counts')}" for n in names]
    union = " UNION ALL ".join(
        f"SELECT *, '{MODES[n].lower()}' AS experiment FROM {n}_counts" for n in names
    )
    return ",".join(parts) + f",\ncounted AS ({union})"


FAULTY_FILTER = "fault_indicator AND (mode <> 'PROPOSED' OR result_type = 'FINAL')"


def all_faulty(*names: str) -> str:
    parts = [emissions(n, n + "_") for n in names]
    union = " UNION ALL ".join(
        f"SELECT *, '{MODES[n].lower()}' AS experiment FROM {n}_emissions WHERE {FAULTY_FILTER}"
        for n in names
    )
    return ",".join(parts) + f",\nfaulty AS ({union})"


EXPECTED = f"CASE WHEN series_id = '{THREE_LABEL}' THEN 12 ELSE 4 END"


def on_seen(ctes: str, query: str) -> str:
    return f"WITH {SEEN},{ctes}\n{query}"


def rnd(expression: str, name: str, digits: int = 6) -> str:
    """Rounded column; the small shift keeps exact halves from splitting engines."""
    return f"round({expression} + 1e-9, {digits}) AS {name}"


def pct(column: str, share: float, name: str) -> str:
    return rnd(f"quantile_cont(CAST({column} AS DOUBLE), {share})", name)


def faulty_windows(name: str) -> str:
    order = "fire_seq, fire_phase, window_end_ms, right(meter_id, 3), phase_group, meter_id, emit_no"

    def unique(test: str) -> str:
        return f"CAST(sum(CASE WHEN {test} AND nth = 1 THEN 1 ELSE 0 END) OVER o AS INTEGER)"

    return on_seen(
        emissions(name),
        f"""
, marked AS (
  SELECT *, row_number() OVER (PARTITION BY phase_group, meter_id
      ORDER BY fire_seq, fire_phase, window_end_ms, emit_no) AS nth
  FROM emissions WHERE {FAULTY_FILTER})
SELECT meter_id, series_id, {text_of('window_start_ms')} AS window_start,
  {text_of('window_end_ms')} AS window_end, mode,
  {unique("phase_group <> 'THREE'")} AS single_unique, {unique("phase_group = 'THREE'")} AS three_unique,
  {unique("true")} AS total_unique, voltage_data
FROM marked WINDOW o AS (ORDER BY {order} ROWS UNBOUNDED PRECEDING)""",
    )


LATENESS_KEYS = {"per_meter": "meter_id", "per_meter_series": "meter_id, series_id", "global": None}


def late(mode: str, alias: str = "late") -> str:
    """Late seconds of every reading under one measure, with day and insert time."""
    keys = LATENESS_KEYS.get(mode)
    part = f"PARTITION BY {keys} " if keys else ""
    upto = "CURRENT ROW" if mode == "post_window_delay" else "1 PRECEDING"
    size = SIZE // 1000
    reference = (
        f"(event_s - ((event_s % {size}) + {size}) % {size}) + {size}"
        if mode == "post_window_delay"
        else "event_s"
    )
    return f"""
{alias}_base AS (
  SELECT *, max(event_s) OVER ({part}ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND {upto}) AS top_s
  FROM (SELECT *, event_ms // 1000 AS event_s, insert_ms // 1000 AS insert_s,
    strftime(make_timestamp(insert_ms * 1000), '%Y-%m-%d') AS day FROM readings)),
{alias} AS (
  SELECT '{mode}' AS mode, day, meter_id, series_id, insert_s,
    CASE WHEN top_s - ({reference}) > 0 THEN top_s - ({reference}) END AS late_s FROM {alias}_base)"""


def bins(by: str, source: str = "late", p: str = "") -> str:
    return f"""
{p}bins AS (
  SELECT {by}, CAST(least(floor(late_s / 60.0 / 6), 499) AS INTEGER) AS bin, count(*) AS n
  FROM {source} WHERE late_s IS NOT NULL GROUP BY ALL),
{p}cum AS (
  SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
  FROM {p}bins)"""


def hist_pct(q: str) -> str:
    """Percentile of the group's ``cum`` rows."""
    wanted = f"(CAST({q} AS DOUBLE) / CAST(100.0 AS DOUBLE) * total)"
    return (
        f"round(arg_min(bin * 6 + ({wanted} - (upto - n)) / CAST(n AS DOUBLE) * 6, bin)"
        f" FILTER (WHERE upto >= {wanted}), 4)"
    )


def hist_pcts(by: str, p: str = "") -> str:
    columns = ", ".join(f"{hist_pct(str(q))} AS p{q}_min" for q in (50, 90, 95, 99))
    return f"\n{p}pcts AS (SELECT {by}, {columns} FROM {p}cum GROUP BY {by})"


PCTS = "p50_min, p90_min, p95_min, p99_min"


def on_readings(ctes: str, query: str) -> str:
    return f"WITH {READINGS},{ctes}\n{query}"


def lateness_rows(mode: str) -> str:
    return on_readings(
        late(mode),
        """SELECT meter_id, series_id, count(*) AS late, CAST(sum(late_s) AS BIGINT) AS sum_s, max(late_s) AS max_s
FROM late WHERE late_s IS NOT NULL GROUP BY ALL""",
    )


def lateness_days(mode: str) -> str:
    keys = LATENESS_KEYS.get(mode)
    unique = (
        f"(SELECT count(*) FROM (SELECT {keys}, min(day) AS d0 FROM late GROUP BY {keys}) f WHERE f.d0 <= s.day)"
        if keys
        else "CAST(1 AS BIGINT)"
    )
    return on_readings(
        f"{late(mode)},{bins('mode, day')},{hist_pcts('mode, day')}",
        f"""
, s AS (SELECT mode, day, count(*) AS total_records, count(late_s) AS late_records,
    round(CAST(count(late_s) AS DOUBLE) / count(*) + 1e-9, 6) AS late_ratio,
    round(CAST(sum(late_s) AS DOUBLE) / 60.0 / count(late_s), 4) AS mean_lateness_min,
    round(max(late_s) / 60.0, 4) AS max_min FROM late GROUP BY ALL)
SELECT mode, day, total_records, late_records, late_ratio, {unique} AS unique_keys, mean_lateness_min, {PCTS}, max_min
FROM s LEFT JOIN pcts USING (mode, day)""",
    )


def lateness_overall() -> str:
    parts, ctes = [], []
    for mode in ("per_meter", "per_meter_series", "post_window_delay"):
        p = f"{mode}_"
        ctes.append(f"{late(mode, p + 'late')},{bins('mode', p + 'late', p)},{hist_pcts('mode', p)}")
        keys = LATENESS_KEYS.get(mode)
        unique = (
            f"(SELECT count(*) FROM (SELECT DISTINCT {keys} FROM readings))" if keys else "CAST(1 AS BIGINT)"
        )
        parts.append(
            f"""SELECT mode, total_records, late_records, late_ratio, {unique} AS unique_keys, {PCTS}
FROM (SELECT mode, count(*) AS total_records, count(late_s) AS late_records,
  round(CAST(count(late_s) AS DOUBLE) / count(*) + 1e-9, 6) AS late_ratio FROM {p}late GROUP BY mode)
LEFT JOIN {p}pcts USING (mode)"""
        )
    return on_readings(",".join(ctes), " UNION ALL ".join(parts))


def lateness_histogram(mode: str, by: str) -> str:
    return on_readings(
        f"{late(mode)},{bins(by)}",
        f"""SELECT {by}, bin * 6 AS bin_left_min, (bin + 1) * 6 AS bin_right_min, coalesce(n, 0) AS count
FROM (SELECT DISTINCT {by} FROM late) CROSS JOIN (SELECT CAST(unnest(range(500)) AS INTEGER) AS bin)
LEFT JOIN bins USING ({by}, bin)""",
    )


METHOD = "['fast', 'delayed', 'baseline', 'proposed'][CAST(user_id % 4 AS INTEGER) + 1]"
ARRIVAL = "CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT)"


def samples(first: str, second: str) -> str:
    return f"""
samples AS (
  SELECT method_key, '465m' AS time_setting, method_key || '_465m' AS experiment,
    method_key || '_' || stage_name AS probe, max(s) * 1000 AS ts_ms, count(*) AS count_in_interval,
    count(*) / CAST(3600 AS DOUBLE) AS events_per_second, CAST(3600000 AS BIGINT) AS interval_ms
  FROM (SELECT {METHOD} AS method_key, CASE WHEN event_id % 2 = 0 THEN '{first}' ELSE '{second}' END AS stage_name,
    {ARRIVAL} AS s FROM events) GROUP BY method_key, stage_name, s // 3600)"""


PARSED = samples("source_after_parse", "post_window_aggregation")
LABEL = "CASE method_key WHEN 'fast' THEN 'SW' WHEN 'delayed' THEN 'DWW' WHEN 'baseline' THEN 'ALW' ELSE 'CBW' END"


def staged(drop_first: int = 0) -> str:
    return f"""{samples('source_after_ingestion', 'post_filter')},
numbered AS (
  SELECT *, {LABEL} AS method_label,
    CASE WHEN probe LIKE '%post_filter' THEN 'Post-filter' ELSE 'Source' END AS stage,
    row_number() OVER (PARTITION BY probe ORDER BY ts_ms, count_in_interval) - {drop_first} AS sample_index
  FROM samples),
staged AS (
  SELECT *, (ts_ms - min(ts_ms) OVER w) / CAST(1000 AS DOUBLE) AS elapsed_sec,
    (max(ts_ms) OVER w - min(ts_ms) OVER w) / CAST(1000 AS DOUBLE) AS longest
  FROM numbered WHERE sample_index > 0 WINDOW w AS (PARTITION BY experiment, stage))"""


def rate_stats(names: dict[str, float], column: str, suffix: str) -> str:
    return ", ".join(pct(column, share, f"{name}_{suffix}") for name, share in names.items())


STAGES = f"""{staged()},
stages AS (
  SELECT method_key, method_label, experiment, time_setting, stage, min(probe) AS probe, count(*) AS samples,
    sum(count_in_interval) AS total_events, max(elapsed_sec) AS duration_sec, max(elapsed_sec) / 60 AS duration_min,
    sum(interval_ms) / CAST(1000 AS DOUBLE) AS total_interval_sec,
    sum(count_in_interval) / (sum(interval_ms) / CAST(1000 AS DOUBLE)) AS weighted,
    avg(events_per_second) AS mean_eps, stddev_pop(events_per_second) AS std_eps,
    min(events_per_second) AS min_eps, max(events_per_second) AS max_eps,
    {', '.join(f'quantile_cont(events_per_second, {s}) AS p{int(s * 100):02d}' for s in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99))},
    min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms
  FROM staged GROUP BY ALL)"""

OVERALL = f"""{STAGES},
overall AS (
  SELECT p.*, s.total_events AS source_events, s.duration_min AS source_min, s.weighted AS source_eps
  FROM stages p JOIN stages s USING (experiment) WHERE p.stage = 'Post-filter' AND s.stage = 'Source'),
base AS (SELECT max(duration_min) FILTER (WHERE method_key = 'baseline') AS b_min,
  max(weighted) FILTER (WHERE method_key = 'baseline') AS b_eps,
  max(duration_min) FILTER (WHERE method_key = 'proposed') AS p_min,
  max(weighted) FILTER (WHERE method_key = 'proposed') AS p_eps FROM overall)"""

ORDER = "CASE method_key WHEN 'fast' THEN 0 WHEN 'delayed' THEN 1 WHEN 'baseline' THEN 2 ELSE 3 END"


def pairs() -> str:
    return f"""{staged()},
candidates AS (
  SELECT p.method_key, p.method_label, p.experiment, p.ts_ms AS post_filter_ts_ms, s.ts_ms AS source_ts_ms,
    p.ts_ms - s.ts_ms AS timestamp_delta_ms, p.elapsed_sec, p.elapsed_sec / 60 AS elapsed_min,
    s.events_per_second AS source_events_per_sec, p.events_per_second AS post_filter_events_per_sec,
    s.count_in_interval AS source_count, p.count_in_interval AS post_filter_count, p.sample_index,
    row_number() OVER (PARTITION BY p.experiment, p.sample_index ORDER BY abs(p.ts_ms - s.ts_ms), s.ts_ms) AS nearness
  FROM staged p JOIN staged s ON p.experiment = s.experiment AND p.stage = 'Post-filter' AND s.stage = 'Source'
    AND abs(p.ts_ms - s.ts_ms) <= 600000),
pairs AS (
  SELECT *, post_filter_events_per_sec / source_events_per_sec AS throughput_ratio,
    post_filter_events_per_sec / source_events_per_sec * 100 AS p FROM candidates WHERE nearness = 1)"""


METRICS = f"""
metrics AS (
  SELECT experiment, max(s) * 1000 AS ts_ms, round(sum(cents) / (count(*) * CAST(100 AS DOUBLE)) + 1e-9, 4) AS cpu_percent,
    round(100 + sum(cents) / (count(*) * CAST(10 AS DOUBLE)) + 1e-9, 4) AS memory, CAST(count(*) AS INTEGER) AS threads
  FROM (SELECT {METHOD} AS experiment, {ARRIVAL} AS s, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
  GROUP BY experiment, s // 3600)"""


def series(where: str = "true", warmup: str = "true") -> str:
    return f"""{METRICS},
kept AS (
  SELECT * FROM (SELECT *, min(ts_ms) OVER (PARTITION BY experiment) AS t0 FROM metrics WHERE {where}) WHERE {warmup}),
series AS (
  SELECT *, (ts_ms - min(ts_ms) OVER w) / CAST(1000 AS DOUBLE) AS elapsed_sec,
    (max(ts_ms) OVER w - min(ts_ms) OVER w) / CAST(1000 AS DOUBLE) AS longest
  FROM kept WINDOW w AS (PARTITION BY experiment))"""


SYSTEM = f"""{series()},
system_rows AS (
  SELECT experiment, max(elapsed_sec) AS runtime_sec, max(elapsed_sec) / 60 AS runtime_min,
    avg(cpu_percent) AS cpu_mean_percent, quantile_cont(cpu_percent, 0.95) AS cpu_p95_percent,
    max(cpu_percent) AS cpu_peak_percent, avg(memory) AS memory_mean_mib,
    quantile_cont(memory, 0.95) AS memory_p95_mib, max(memory) AS memory_peak_mib,
    count(*) AS system_samples, quantile_cont(CAST(threads AS DOUBLE), 0.95) AS threads_p95
  FROM series GROUP BY experiment)"""

TOTALS = f"""{PARSED},
totals AS (
  SELECT method_key,
    {', '.join(f'''sum(count_in_interval) FILTER (WHERE probe LIKE '%{part}') * CAST(1000 AS DOUBLE)
      / sum(interval_ms) FILTER (WHERE probe LIKE '%{part}') AS {prefix}_weighted_eps,
    avg(events_per_second) FILTER (WHERE probe LIKE '%{part}') AS {prefix}_mean_eps,
    quantile_cont(events_per_second, 0.95) FILTER (WHERE probe LIKE '%{part}') AS {prefix}_p95_eps,
    sum(count_in_interval) FILTER (WHERE probe LIKE '%{part}') AS {total}''' for part, prefix, total in (
        ('source_after_parse', 'source_throughput', 'source_events_total'),
        ('post_window_aggregation', 'output_emission_rate', 'output_emitted_events_total')))}
  FROM samples GROUP BY method_key)"""


def comparison() -> str:
    def saving(column: str, name: str) -> str:
        return rnd(f"(r.{column} - p.{column}) / nullif(r.{column}, 0) * 100", name)

    def change(column: str, name: str) -> str:
        return rnd(f"(p.{column} - r.{column}) / nullif(r.{column}, 0) * 100", name)

    shown = ("cpu_mean_percent", "memory_mean_mib", "runtime_sec", "source_throughput_weighted_eps",
             "output_emission_rate_weighted_eps")
    return f"""WITH {SYSTEM},{TOTALS},
both_rows AS (SELECT * FROM system_rows JOIN totals ON experiment = method_key)
SELECT 'proposed vs ' || r.experiment AS comparison, r.experiment AS reference_experiment,
  'proposed' AS proposed_experiment,
  {', '.join(saving(f'cpu_{s}_percent', f'cpu_{s}_saving_percent') for s in ('mean', 'p95', 'peak'))},
  {', '.join(saving(f'memory_{s}_mib', f'memory_{s}_saving_percent') for s in ('mean', 'p95', 'peak'))},
  {rnd('p.runtime_sec - r.runtime_sec', 'runtime_change_sec')}, {change('runtime_sec', 'runtime_change_percent')},
  {change('source_throughput_weighted_eps', 'source_throughput_change_percent')},
  {change('output_emission_rate_weighted_eps', 'output_emission_rate_change_percent')},
  {', '.join(rnd(f'p.{c}', f'proposed_{c}') for c in shown)}, {', '.join(rnd(f'r.{c}', f'reference_{c}') for c in shown)}
FROM both_rows r JOIN both_rows p ON p.experiment = 'proposed' AND r.experiment <> 'proposed'"""


DAMAGED = """
numbered AS (
  SELECT *, 0 AS row_no FROM counted
  UNION ALL SELECT * REPLACE (99 AS output_count, 99 AS final_count), 1 FROM counted WHERE CAST(meter_id AS BIGINT) % 7 = 0
  UNION ALL SELECT * REPLACE (CAST(0 AS BIGINT) AS window_start_ms, CAST(0 AS BIGINT) AS window_end_ms), 2
    FROM counted WHERE CAST(meter_id AS BIGINT) % 11 = 0)"""


def summary(source: str) -> str:
    key = f"experiment, {KEY}"
    return f"""
first_rows AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY row_no) AS nth FROM {source}
  WHERE NOT (window_start_ms = 0 AND window_end_ms = 0)),
valid AS (
  SELECT experiment, count(*) FILTER (WHERE nth = 1) AS emitted_windows,
    count(*) FILTER (WHERE nth > 1) AS duplicate_window_rows,
    count(*) FILTER (WHERE nth = 1 AND early_purged AND final_count >= {EXPECTED}) AS early_purged_windows,
    CAST(sum(output_count) FILTER (WHERE nth = 1) AS BIGINT) AS valid_window_outputs,
    avg(final_count) FILTER (WHERE nth = 1) AS final_count_mean,
    quantile_cont(CAST(final_count AS DOUBLE), 0.95) FILTER (WHERE nth = 1) AS final_count_p95,
    avg(distinct_slot_count) FILTER (WHERE nth = 1) AS distinct_slot_count_mean,
    quantile_cont(CAST(distinct_slot_count AS DOUBLE), 0.95) FILTER (WHERE nth = 1) AS distinct_slot_count_p95
  FROM first_rows GROUP BY experiment),
bad AS (
  SELECT experiment, CAST(count(*) AS BIGINT) AS invalid_window_rows,
    count(DISTINCT (mode, meter_id, series_id)) AS invalid_unique_windows,
    CAST(sum(output_count) AS BIGINT) AS missing_window_metadata_outputs
  FROM {source} WHERE window_start_ms = 0 AND window_end_ms = 0 GROUP BY experiment),
summary AS (
  SELECT v.*, coalesce(invalid_window_rows, 0) AS invalid_window_rows,
    coalesce(invalid_unique_windows, 0) AS invalid_unique_windows,
    coalesce(missing_window_metadata_outputs, 0) AS missing_window_metadata_outputs,
    valid_window_outputs + coalesce(missing_window_metadata_outputs, 0) AS total_outputs
  FROM valid v LEFT JOIN bad USING (experiment))"""


SUMMARY_COLUMNS = f"""experiment, emitted_windows, duplicate_window_rows, early_purged_windows, valid_window_outputs,
  {rnd('final_count_mean', 'final_count_mean')}, {rnd('final_count_p95', 'final_count_p95')},
  {rnd('distinct_slot_count_mean', 'distinct_slot_count_mean')}, {rnd('distinct_slot_count_p95', 'distinct_slot_count_p95')},
  invalid_window_rows, invalid_unique_windows, missing_window_metadata_outputs,
  {rnd('early_purged_windows / CAST(emitted_windows AS DOUBLE)', 'early_purge_ratio')}, total_outputs,
  {rnd('total_outputs / CAST(emitted_windows AS DOUBLE)', 'mean_output_count')}"""


def inferred() -> str:
    return on_seen(
        completeness(),
        f"""
, doubled AS (
  SELECT *, 0 AS row_no FROM emissions WHERE result_type = 'FINAL'
  UNION ALL SELECT *, 1 FROM emissions WHERE result_type = 'FINAL' AND CAST(meter_id AS BIGINT) % 7 = 0),
f AS (SELECT *, {EXPECTED} AS expected, row_number() OVER (PARTITION BY {KEY} ORDER BY row_no) AS nth FROM doubled),
agg AS (
  SELECT 'proposed' AS experiment, count(*) FILTER (WHERE nth = 1) AS emitted_windows,
    count(*) FILTER (WHERE nth > 1) AS duplicate_window_rows,
    count(*) FILTER (WHERE nth = 1 AND finalization_reason = 'COMPLETENESS') AS early_purged_windows,
    CAST(sum(CASE WHEN count >= ceil(expected * 0.75) THEN 2 ELSE 1 END) FILTER (WHERE nth = 1) AS BIGINT) AS valid_window_outputs,
    avg(count) FILTER (WHERE nth = 1) AS final_count_mean,
    quantile_cont(CAST(count AS DOUBLE), 0.95) FILTER (WHERE nth = 1) AS final_count_p95 FROM f)
SELECT experiment, emitted_windows, duplicate_window_rows, early_purged_windows, valid_window_outputs,
  {rnd('final_count_mean', 'final_count_mean')}, {rnd('final_count_p95', 'final_count_p95')},
  CAST(0 AS BIGINT) AS invalid_window_rows, CAST(0 AS BIGINT) AS invalid_unique_windows,
  CAST(0 AS BIGINT) AS missing_window_metadata_outputs,
  {rnd('early_purged_windows / CAST(emitted_windows AS DOUBLE)', 'early_purge_ratio')},
  valid_window_outputs AS total_outputs,
  {rnd('valid_window_outputs / CAST(emitted_windows AS DOUBLE)', 'mean_output_count')} FROM agg""",
    )


FINALS = ", finals AS (SELECT *, finalization_latency_ms / CAST(60000 AS DOUBLE) AS lat, latency_reduction_ms / CAST(60000 AS DOUBLE) AS saved, allowed_lateness_ms / CAST(60000 AS DOUBLE) AS allowed FROM emissions WHERE result_type = 'FINAL')"


def distribution(with_reason: bool) -> str:
    if with_reason:
        immediate, deadline = "finalization_latency_ms <= 0", "finalization_reason = 'DEADLINE'"
        completed = f"""count(*) FILTER (WHERE finalization_reason = 'COMPLETENESS') AS completeness_windows,
  {rnd("avg(CASE WHEN finalization_reason = 'COMPLETENESS' THEN 1 ELSE 0 END)", 'completeness_ratio')},"""
    else:
        immediate, completed = "finalization_latency_ms <= 60000", ""
        deadline = "finalization_latency_ms >= allowed_lateness_ms - 1"
    return on_seen(
        completeness(),
        f"""{FINALS}
SELECT count(*) AS windows, {rnd('avg(lat)', 'latency_mean_min')}, {rnd('stddev_samp(lat)', 'latency_std_min')},
  {rnd('min(lat)', 'latency_min_min')},
  {', '.join(pct('lat', s, f'latency_p{int(s * 100)}_min') for s in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))},
  {rnd('max(lat)', 'latency_max_min')}, count(*) FILTER (WHERE {immediate}) AS immediate_windows,
  {rnd(f'avg(CASE WHEN {immediate} THEN 1 ELSE 0 END)', 'immediate_ratio')}, {completed}
  {pct('allowed', 0.5, 'allowed_lateness_median_min')}, {rnd('max(allowed)', 'allowed_lateness_max_min')},
  count(*) FILTER (WHERE {deadline}) AS deadline_windows,
  {rnd(f'avg(CASE WHEN {deadline} THEN 1 ELSE 0 END)', 'deadline_ratio')},
  {rnd('avg(saved)', 'latency_reduction_mean_min')}, {pct('saved', 0.5, 'latency_reduction_p50_min')},
  {pct('saved', 0.95, 'latency_reduction_p95_min')} FROM finals""",
    )


def missing(test: str = "true") -> str:
    return f"""SELECT %s AS phase, count(*) AS windows, CAST(sum({EXPECTED}) AS BIGINT) AS expected,
  CAST(sum(final_count) AS BIGINT) AS final_count, CAST(sum(distinct_slot_count) AS BIGINT) AS distinct_slot_count,
  CAST(sum(greatest(0, {EXPECTED} - final_count)) AS BIGINT) AS missing_by_count,
  CAST(sum(greatest(0, {EXPECTED} - distinct_slot_count)) AS BIGINT) AS missing_by_slots,
  count(*) FILTER (WHERE final_count < {EXPECTED}) AS incomplete_by_count,
  count(*) FILTER (WHERE distinct_slot_count < {EXPECTED}) AS incomplete_by_slots
FROM counted WHERE {test}"""


def output_counts(name: str) -> str:
    return on_seen(f"{emissions(name)},{counts('emissions', 'counted')}", "SELECT * FROM counted")


def line_of(emission_filter: str, line: str) -> str:
    return on_seen(completeness(), f"SELECT {KEY}, {line} AS line FROM emissions {emission_filter}")


def minutes(column: str) -> str:
    return f"printf('%.2f', {column} / CAST(60000 AS DOUBLE))"


# ------------------------------------------------------------ text lines

LINES = """
stamped AS (SELECT *, event_id % 16 AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day FROM events),
lines AS (
  SELECT event_id AS arrival_seq, day, 'lines-' || day AS file_name, CASE WHEN kind = 7 THEN '  ' ELSE
    CASE WHEN kind = 3 THEN 'Row{' ELSE 'Struct{' END || 'series_id=' || event_type || ',location_id=place ' || (user_id % 10)
    || CASE WHEN kind = 8 THEN ', upper floor' ELSE '' END || CASE WHEN kind = 4 THEN '' ELSE CASE WHEN kind = 11 THEN ', ' ELSE ',' END || 'meter_id= ' || user_id || ' ' END
    || ',time=' || CASE WHEN kind = 5 THEN stamp[1:5] || '13' || stamp[8:] ELSE stamp || '.25' END
    || ',value=' || CASE WHEN kind = 6 THEN 'n/a' ELSE (event_id % 977) || '.5' END
    || ',value_status=ok,insert_time=' || stamp || ',extract_time=' || CASE WHEN kind = 9 THEN 'today' ELSE stamp END
    || CASE WHEN kind = 10 THEN '' ELSE '}' END END AS text
  FROM stamped)"""


def parsed(pattern: str, trimmed: bool) -> str:
    """Fields of a line by a pattern around the name."""

    def field(name: str) -> str:
        found = f"'{pattern.replace('NAME', name)}'"
        return f"CASE WHEN framed AND regexp_matches(body, {found}) THEN {'trim' if trimmed else ''}(regexp_extract(body, {found}, 1)) END AS {name}"

    names = ("series_id", "location_id", "meter_id", "time", "value", "value_status", "insert_time", "extract_time")
    stamps = ", ".join(f"epoch_ms(try_cast({c} AS TIMESTAMP)) AS {ms}" for c, ms in (("time", "event_ms"), ("insert_time", "insert_ms"), ("extract_time", "extract_ms")))
    return f"""{LINES},
framed AS (SELECT *, starts_with(text, 'Struct{{') AND ends_with(text, '}}') AS framed, text[8:-2] AS body FROM lines),
fields AS (SELECT arrival_seq, day, file_name, text, framed, {', '.join(field(n) for n in names)} FROM framed),
parsed AS (SELECT * EXCLUDE (value), value AS value_text, try_cast(value AS DOUBLE) AS value, {stamps} FROM fields)"""


STRICT_ERROR = """CASE WHEN trim(text) = '' THEN 'empty line' WHEN NOT framed THEN 'not a Struct{...} line'
  WHEN series_id IS NULL OR location_id IS NULL OR meter_id IS NULL OR time IS NULL OR value_text IS NULL OR value_status IS NULL OR insert_time IS NULL OR extract_time IS NULL THEN 'missing field'
  WHEN event_ms IS NULL OR insert_ms IS NULL OR extract_ms IS NULL THEN 'bad time' WHEN value IS NULL THEN 'bad value' END"""
LOOSE_ERROR = """CASE WHEN NOT framed THEN 'not a Struct{...} line' WHEN series_id IS NULL OR meter_id IS NULL THEN 'missing field'
  WHEN event_ms IS NULL THEN 'bad time' END"""
LINE_COLUMNS = "arrival_seq, series_id, location_id, meter_id, event_ms, value, value_status, insert_ms, extract_ms"
PAUSE_ROWS = f"""
logged AS (
  SELECT event_id AS n, {METHOD} AS experiment, (epoch_us(ts) // 1000000) * 1000 + 250 AS ts_ms, ['Young', 'Full', 'Remark', 'Cleanup', 'Sweep'][CAST(event_id % 5 AS INTEGER) + 1] AS type FROM events),
pauses AS (
  SELECT n AS arrival_seq, experiment, ts_ms, type, CASE WHEN n % 7 <> 0 THEN CAST(n % 300 + 20 AS DOUBLE) END AS before_mb, CASE WHEN n % 7 <> 0 THEN CAST(n % 20 AS DOUBLE) END AS after_mb,
    CASE WHEN n % 7 <> 0 THEN CAST(512 AS DOUBLE) END AS capacity_mb, CAST(n % 40 AS DOUBLE) + 0.125 AS duration_ms
  FROM logged WHERE n % 11 <> 0 AND type <> 'Sweep')"""


def text_lines() -> dict[str, str]:
    strict, loose = parsed("(?:^|,)NAME=(.*?)(?:,[a-zA-Z_]+=|$)", True), parsed("(?:^|[^a-zA-Z_])NAME=([^,}]+)", False)
    minutes = "greatest((max(ts_ms) - min(ts_ms)) / 1000.0 / 60.0, 1e-9)"
    return {
        "parsed_lines": f"WITH {strict} SELECT {LINE_COLUMNS}, {STRICT_ERROR} AS parse_error, CASE WHEN {STRICT_ERROR} IS NOT NULL THEN text END AS raw FROM parsed",
        "profiled_lines": f"WITH {loose} SELECT {LINE_COLUMNS}, {LOOSE_ERROR} AS parse_error, CASE WHEN {LOOSE_ERROR} IS NOT NULL THEN text END AS raw FROM parsed WHERE trim(text) <> ''",
        "profiled_files": f"""WITH {loose},
files AS (SELECT day, file_name, count(*) FILTER (WHERE ({LOOSE_ERROR}) IS NULL) AS records, count(*) FILTER (WHERE ({LOOSE_ERROR}) IS NOT NULL) AS errors FROM parsed WHERE trim(text) <> '' GROUP BY ALL)
SELECT file_name, records, errors, CAST(sum(records) OVER (ORDER BY day) AS BIGINT) AS total_records, CAST(sum(errors) OVER (ORDER BY day) AS BIGINT) AS total_errors FROM files""",
        "pause_rows": f"WITH {PAUSE_ROWS} SELECT *, before_mb - after_mb AS recovered_mb FROM pauses",
        "pause_summary": f"""WITH {PAUSE_ROWS}
SELECT experiment, count(*) AS gc_events, {rnd(f'count(*) / {minutes}', 'gc_events_per_min')}, {rnd('sum(duration_ms)', 'gc_total_pause_ms')},
  {rnd('quantile_cont(duration_ms, 0.95)', 'gc_p95_pause_ms')}, {rnd('max(duration_ms)', 'gc_max_pause_ms')},
  count(*) FILTER (WHERE type = 'Full') AS full_gc_events, count(*) FILTER (WHERE type = 'Young') AS young_gc_events FROM pauses GROUP BY experiment""",
    }


# metric, column, unit, whether lower is better
SYSTEM_METRICS = (
    ("duration_sec", "runtime_sec", "sec", True), ("cpu_mean", "cpu_mean_percent", "%", True),
    ("cpu_p95", "cpu_p95_percent", "%", True), ("memory_mean", "memory_mean_mib", "MiB", True),
    ("memory_p95", "memory_p95_mib", "MiB", True), ("memory_max", "memory_peak_mib", "MiB", True),
)
PAUSE_METRICS = (
    ("gc_events_per_min", "gc_events_per_min", "events/min", True), ("gc_total_pause_ms", "gc_total_pause_ms", "ms", True),
    ("gc_p95_pause_ms", "gc_p95_pause_ms", "ms", True), ("full_gc_events", "full_gc_events", "count", True),
)
FINAL_METRICS = (
    ("finalization_samples", "finalized_windows", "count", False),
    ("finalization_latency_mean_min", "finalization_latency_mean_min", "min", True),
    ("finalization_latency_p95_min", "finalization_latency_p95_min", "min", True),
    ("latency_reduction_mean_min", "latency_reduction_mean_min", "min", False),
    ("latency_reduction_p95_min", "latency_reduction_p95_min", "min", False),
    ("latency_reduction_mean_ratio", "latency_reduction_mean_ratio", "ratio", False),
)


def metric_table_all(sql: dict[str, str]) -> str:
    rows = [
        f"SELECT '{category}' AS category, experiment, '{metric}' AS metric, '{unit}' AS unit, {str(lower).lower()} AS lower_is_better, CAST({column} AS DOUBLE) AS v FROM {table}"
        for category, table, metrics in (("system", "system_part", SYSTEM_METRICS), ("gc", "pause_part", PAUSE_METRICS), ("finalization", "final_part", FINAL_METRICS))
        for metric, column, unit, lower in metrics
    ]
    rows += [
        f"SELECT 'throughput', experiment, 'throughput_' || stage || '_{name}_eps', 'events/sec', false, {name} FROM rate_part"
        for name in ("weighted", "p95")
    ]
    modes = ("fast", "delayed", "baseline", "proposed")
    return f"""WITH system_part AS ({sql['system_summary']}), pause_part AS ({sql['pause_summary']}), final_part AS ({sql['latency_summary']}),
rate_part AS (WITH {PARSED} SELECT method_key AS experiment, substr(probe, length(method_key) + 2) AS stage,
  sum(count_in_interval) / (sum(interval_ms) / CAST(1000 AS DOUBLE)) AS weighted, quantile_cont(CAST(events_per_second AS DOUBLE), 0.95) AS p95 FROM samples GROUP BY ALL),
long AS ({' UNION ALL '.join(rows)}),
wide AS (SELECT category, metric, unit, lower_is_better, {', '.join(f"max(v) FILTER (WHERE experiment = '{m}') AS {m}" for m in modes)} FROM long GROUP BY ALL)
SELECT category, metric, unit, lower_is_better, {', '.join(rnd(m, m) for m in modes)}, {rnd('proposed - baseline', 'delta_proposed_vs_baseline')},
  {rnd('(proposed - baseline) / nullif(baseline, 0) * 100', 'delta_pct_proposed_vs_baseline')} FROM wide"""


def oracle_sql() -> dict[str, str]:
    start, end = text_of("window_start_ms"), text_of("window_end_ms")
    shape = f"{text_of('window_start_ms')} AS window_start, {text_of('window_end_ms')} AS window_end"
    k_text = "CASE WHEN k = 0 THEN '0' ELSE CAST(k AS VARCHAR) || ['m', 'h', 'd', 'x'][CAST(event_id % 4 AS INTEGER) + 1] END"
    sql = {
        "replay_watermark": f"WITH {SEEN} SELECT arrival_seq, max_seen_ms, max_seen_ms - {DAY} AS delayed_ms FROM seen",
        "window_arithmetic": f"""WITH {SEEN}
SELECT arrival_seq, window_start_ms, CAST((event_ms - window_start_ms) // {SLOT} AS INTEGER) AS slot,
  CASE series_id WHEN '{L1}' THEN 0 WHEN '{L2}' THEN 1 ELSE 2 END AS phase,
  CASE WHEN phase_group = 'THREE' THEN 12 ELSE 4 END AS expected, {start} AS window_start,
  CAST(floor((event_ms - 1706000000000) / {SIZE}.0) AS BIGINT) * {SIZE} AS below_zero FROM seen""",
        "scalar_functions": f"""WITH base AS (
  SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS k,
    ['fast', 'Baseline2', 'ALW', 'proposed', 'other'][CAST(event_id % 5 AS INTEGER) + 1] AS method,
    ['fast', 'delayed', 'baseline', 'mystery'][CAST(event_id % 4 AS INTEGER) + 1] AS probe_head,
    CASE WHEN event_id % 3 = 0 THEN 'post_filter' ELSE 'source_after_ingestion' END AS probe_tail FROM events),
t AS (SELECT *, {k_text} AS txt, k * k * k AS sec, event_id % 3 AS m FROM base)
SELECT event_id,
  CASE WHEN txt = '0' THEN 0 WHEN txt LIKE '%m' THEN k * 60000 WHEN txt LIKE '%h' THEN k * 3600000
       WHEN txt LIKE '%d' THEN k * 86400000 END AS duration_ms,
  CASE WHEN sec < 60 THEN sec || 's' WHEN sec < 3600 THEN CAST(round_even(sec / CAST(60 AS DOUBLE), 0) AS BIGINT) || 'm'
       WHEN sec < 86400 THEN printf('%dh %02dm', sec // 3600, (sec % 3600) // 60)
       ELSE printf('%dd %02dh', sec // 86400, (sec % 86400) // 3600) END AS duration_label,
  CASE method WHEN 'fast' THEN 'SW' WHEN 'Baseline2' THEN 'DWW' WHEN 'proposed' THEN 'CBW' ELSE method END AS method_label,
  CASE method WHEN 'fast' THEN 0 WHEN 'Baseline2' THEN 1 WHEN 'ALW' THEN 2 WHEN 'proposed' THEN 3 ELSE 4 END AS method_order,
  CASE WHEN probe_head = 'mystery' THEN 'unknown' ELSE probe_head END AS probe_mode,
  CASE WHEN probe_head = 'mystery' THEN 'mystery_' || probe_tail ELSE probe_tail END AS probe_stage,
  CASE WHEN probe_tail = 'post_filter' THEN 'Post-filter' ELSE 'Source' END AS stage_label,
  CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE user_id || '_Ström L1' END AS legacy_meter,
  CASE WHEN event_type = 'view' THEN '{L2}' ELSE 'unknown' END AS legacy_series,
  round(CASE WHEN m = 0 THEN 0 ELSE k / CAST(m AS DOUBLE) END + 1e-9, 6) AS ratio,
  round(CASE WHEN m <> 0 THEN (k - m) / CAST(m AS DOUBLE) * 100 END + 1e-9, 6) AS change_pct,
  round(CASE WHEN m <> 0 THEN (m - k) / CAST(m AS DOUBLE) * 100 END + 1e-9, 6) AS saving_pct,
  CAST(least(floor(sec / CAST(60 AS DOUBLE) / 6), 499) AS INTEGER) AS lateness_bin,
  k % 10 >= 6 AS preliminary_met, k % 10 >= 8 AS final_met,
  CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE k % 10 >= 8 END AS early_purge FROM t""",
        "phase_routing": f"WITH {READINGS} SELECT arrival_seq, meter_id, series_id, phase_group FROM readings WHERE phase_group IS NOT NULL",
        "first_arrivals": f"WITH {READINGS} SELECT arrival_seq, meter_id, event_ms FROM readings ORDER BY arrival_seq LIMIT 1000",
        "late_records": on_seen(
            placed("sw"),
            "SELECT arrival_seq, phase_group, meter_id, window_start_ms, event_ms, max_seen_ms FROM placed WHERE dropped",
        ),
        "sum_windows": on_seen(
            placed("sw"),
            f"""
, w AS (SELECT {GROUP}, count(*) AS count, round(sum(value), 2) AS sum_value FROM placed WHERE NOT dropped GROUP BY ALL)
SELECT *, {shape}, '[BASELINE] Window: ' || {start} || ' TO ' || {end} || ' | Meter: ' || meter_id || ' | Count: ' || count
    || ' | Sum Value: ' || printf('%.2f', sum_value) AS line FROM w""",
        ),
        "sum_windows_with_completeness": on_seen(
            f"{placed('alw')},{passes(DAY, 'passes', 'placed')}",
            f"""
, w AS (SELECT {GROUP}, count(*) AS count, round(sum(value), 2) AS sum_value FROM placed WHERE NOT dropped GROUP BY ALL),
c AS (SELECT w.*, {shape}, printf('%.1f%%', count / CAST(4 AS DOUBLE) * 100) AS completeness,
  CASE WHEN count >= 4 OR pass_seq IS NOT NULL THEN 'FINAL' ELSE 'PRELIMINARY' END AS result_type
  FROM w LEFT JOIN passes USING (window_end_ms))
SELECT *, '[' || result_type || '] Window: ' || window_start || ' TO ' || window_end || ' | Meter: ' || meter_id
  || ' | Count: ' || count || ' | Completeness: ' || completeness || ' | Sum Value: ' || printf('%.2f', sum_value) AS line FROM c""",
        ),
        "distinct_slots": on_seen(
            placed("alw"),
            f"""SELECT phase_group, meter_id, window_start_ms, CAST(count(DISTINCT
  CASE WHEN phase_group = 'THREE' THEN ((event_ms - window_start_ms) // {SLOT}) * 3 + phase
       ELSE (event_ms - window_start_ms) // {SLOT} END) AS INTEGER) AS distinct_slot_count, count(*) AS count
FROM placed WHERE NOT dropped GROUP BY ALL""",
        ),
        "completeness_windows": on_seen(
            placed("cbw"),
            f"""SELECT {GROUP}, count(*) FILTER (WHERE NOT dropped) AS taken, count(*) FILTER (WHERE dropped) AS dropped,
  greatest(count(*) FILTER (WHERE NOT dropped) - CASE WHEN phase_group = 'THREE' THEN 12 ELSE 4 END, 0) AS swallowed
FROM placed GROUP BY {GROUP} HAVING count(*) FILTER (WHERE NOT dropped) > 0""",
        ),
        "completeness_contract": on_seen(
            completeness(),
            """SELECT count(*) FILTER (WHERE result_type = 'FINAL') AS finals,
  count(*) FILTER (WHERE result_type = 'PRELIMINARY') AS preliminaries, CAST(0 AS BIGINT) AS violations FROM emissions""",
        ),
        "run_totals": on_seen(
            ",".join(placed(n, f"{n}_placed") for n in POLICIES),
            " UNION ALL ".join(
                f"""SELECT '{MODES[n].lower()}' AS mode, (SELECT count(*) FROM readings) AS total_input_records,
  count(*) FILTER (WHERE dropped) AS dropped_records,
  round(count(*) FILTER (WHERE dropped) / CAST((SELECT count(*) FROM readings) AS DOUBLE) + 1e-9, 6) AS dropped_record_ratio
FROM {n}_placed"""
                for n in POLICIES
            ),
        ),
        "probe_samples": on_seen(
            completeness(),
            """
, points_in AS (
  SELECT 'proposed_source_after_ingestion' AS probe, insert_ms AS ms FROM readings
  UNION ALL SELECT 'proposed_source_after_parse', insert_ms FROM readings
  UNION ALL SELECT 'proposed_post_filter', insert_ms FROM readings WHERE phase_group IS NOT NULL
  UNION ALL SELECT 'proposed_post_window_aggregation', insert_ms FROM emissions
    JOIN readings ON arrival_seq = fire_seq WHERE fire_phase = 0)
SELECT probe, (ms // 21600000 + 1) * 21600000 AS ts_ms, count(*) AS count_in_interval,
  round(count(*) / CAST(21600 AS DOUBLE) + 1e-9, 6) AS events_per_second, CAST(21600000 AS BIGINT) AS interval_ms
FROM points_in GROUP BY ALL""",
        ),
        "chained_probe_samples": f"""WITH RECURSIVE {READINGS},
per_ms AS (SELECT CASE WHEN phase_group IS NULL THEN 'other' ELSE 'kept' END AS probe, insert_ms AS ms, count(*) AS n
  FROM readings GROUP BY ALL),
chain AS (
  SELECT probe, min(ms) AS start_ms, 0 AS nr FROM per_ms GROUP BY probe
  UNION ALL
  SELECT c.probe, min(p.ms), c.nr + 1 FROM chain c JOIN per_ms p ON p.probe = c.probe AND p.ms >= c.start_ms + 10800000
  GROUP BY c.probe, c.nr),
spans AS (SELECT *, lead(start_ms) OVER (PARTITION BY probe ORDER BY nr) AS ts_ms FROM chain)
SELECT s.probe, s.ts_ms, CAST(sum(n) + CASE WHEN nr = 0 THEN 1 ELSE 0 END AS BIGINT) AS count_in_interval,
  round((sum(n) + CASE WHEN nr = 0 THEN 1 ELSE 0 END) / ((s.ts_ms - start_ms) / CAST(1000 AS DOUBLE)), 3) AS events_per_second,
  s.ts_ms - start_ms AS interval_ms
FROM spans s JOIN per_ms p ON p.probe = s.probe AND p.ms >= start_ms AND p.ms < s.ts_ms GROUP BY s.probe, s.ts_ms, start_ms, nr""",
        "latency_rows": on_seen(
            completeness(),
            f"""SELECT mode, result_type, finalization_reason, meter_id, series_id, count, fault_indicator, window_start_ms,
  window_end_ms, watermark_at_purge_ms, allowed_lateness_ms, finalization_latency_ms, latency_reduction_ms
FROM emissions WHERE result_type = 'FINAL'""",
        ),
        "emission_text": on_seen(
            completeness(),
            f"""SELECT {KEY}, emit_no, '[PROPOSED_' || CASE WHEN result_type = 'FINAL' THEN 'PURGE' ELSE 'UPDATE' END
  || '] Window: ' || {start} || ' TO ' || {end} || ' | Meter: ' || meter_id || ' | Series: ' || series_id
  || ' | Count: ' || count || ' | Completeness: ' || completeness || ' | FinalizationReason: ' || finalization_reason
  || ' | Fault: ' || CAST(fault_indicator AS VARCHAR) || ' | PurgeTimeMin: ' || {minutes(f'(window_end_ms + {DAY})')}
  AS line FROM emissions""",
        ),
        "latency_text": line_of(
            "WHERE result_type = 'FINAL'",
            f"""'[FINALIZATION_LATENCY] Mode: ' || mode || ' | Window: ' || {start} || ' TO ' || {end} || ' | Meter: ' || meter_id
  || ' | Series: ' || series_id || ' | Count: ' || count || ' | Completeness: ' || completeness || ' | Fault: '
  || CAST(fault_indicator AS VARCHAR) || ' | FinalizationReason: ' || finalization_reason || ' | WatermarkAtPurgeMin: '
  || {minutes('watermark_at_purge_ms')} || ' | WindowEndMin: ' || {minutes('window_end_ms')} || ' | AllowedLatenessMin: '
  || {minutes('allowed_lateness_ms')} || ' | FinalizationLatencyMin: ' || {minutes('finalization_latency_ms')}
  || ' | LatencyReductionMin: ' || {minutes('latency_reduction_ms')}""",
        ),
        "meter_classes": """SELECT CAST(c_custkey AS VARCHAR) AS meter_id, 'E-Meter ' || kind AS type_description,
  CAST(c_custkey % 4 AS INTEGER) AS phases,
  CASE kind WHEN '3-Phase' THEN 'THREE' WHEN '1-Phase' THEN 'SINGLE' ELSE 'OTHER' END AS class
FROM (SELECT *, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN '1-Phase'
  WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN '3-Phase' ELSE 'CT' END AS kind FROM customer)
WHERE c_custkey % 10 <> 0""",
        "output_summary": on_seen(
            f"{all_counts('alw', 'cbw')},{DAMAGED},{summary('numbered')}",
            f"""
, ref AS (SELECT experiment AS reference_window_experiment, emitted_windows AS reference_emitted_windows FROM summary
  WHERE experiment = 'baseline')
SELECT {SUMMARY_COLUMNS}, reference_window_experiment, reference_emitted_windows,
  {rnd('emitted_windows / CAST(reference_emitted_windows AS DOUBLE)', 'emitted_window_coverage_ratio')} FROM summary, ref""",
        ),
        "inferred_output_summary": inferred(),
        "mechanism_summary": on_seen(
            f"{all_counts(*POLICIES)},numbered AS (SELECT *, 0 AS row_no FROM counted),{summary('numbered')}",
            f"""SELECT experiment AS method,
  CASE experiment WHEN 'fast' THEN 'SW' WHEN 'delayed' THEN 'DWW' WHEN 'baseline' THEN 'ALW' ELSE 'CBW' END AS method_label,
  CASE experiment WHEN 'fast' THEN 0 WHEN 'delayed' THEN 1 WHEN 'baseline' THEN 2 ELSE 3 END AS method_order,
  emitted_windows, {rnd('emitted_windows / CAST(1000000 AS DOUBLE)', 'emitted_windows_m')}, total_outputs,
  {rnd('total_outputs / CAST(1000000 AS DOUBLE)', 'total_outputs_m')}, valid_window_outputs,
  missing_window_metadata_outputs, early_purged_windows,
  {rnd('early_purged_windows / CAST(emitted_windows AS DOUBLE)', 'early_purge_ratio')}, duplicate_window_rows,
  invalid_window_rows, invalid_unique_windows FROM summary""",
        ),
        "output_distribution": on_seen(
            all_counts("alw", "cbw"),
            "SELECT experiment, output_count, count(*) AS windows FROM counted GROUP BY ALL",
        ),
        "output_distribution_pivot": on_seen(
            all_counts("alw", "cbw"),
            """SELECT output_count, count(*) FILTER (WHERE experiment = 'baseline') AS baseline,
  count(*) FILTER (WHERE experiment = 'proposed') AS proposed FROM counted GROUP BY ALL""",
        ),
        "output_totals": on_seen(
            all_counts("alw", "cbw"),
            "SELECT "
            + ", ".join(
                f"""CAST(sum(output_count) FILTER (WHERE mode = '{m}') AS BIGINT) AS {p}_outputs,
  round(quantile_cont(CAST(output_count AS DOUBLE), 0.5) FILTER (WHERE mode = '{m}') + 1e-9, 6) AS {p}_median,
  round(quantile_cont(CAST(output_count AS DOUBLE), 0.95) FILTER (WHERE mode = '{m}') + 1e-9, 6) AS {p}_p95"""
                for m, p in (("PROPOSED", "proposed"), ("BASELINE", "baseline"))
            )
            + """, CAST(greatest(floor(quantile_cont(CAST(output_count AS DOUBLE), 0.99)), 5) AS BIGINT) AS axis_limit,
  round(sum(output_count) FILTER (WHERE mode = 'BASELINE') / CAST(sum(output_count) FILTER (WHERE mode = 'PROPOSED') AS DOUBLE) + 1e-9, 6)
    AS baseline_over_proposed FROM counted""",
        ),
        "outputs_cdf": on_seen(
            all_counts("alw", "cbw"),
            """, v AS (SELECT mode, output_count, count(*) AS windows FROM counted GROUP BY ALL)
SELECT *, round(sum(windows) OVER (PARTITION BY mode ORDER BY output_count) / CAST(sum(windows) OVER (PARTITION BY mode) AS DOUBLE) + 1e-9, 6)
  AS cumulative_share FROM v""",
        ),
        "early_purge_shares": on_seen(
            all_counts("cbw"),
            """SELECT series_id, count(*) AS windows, round(avg(CASE WHEN early_purged_raw THEN 1 ELSE 0 END) + 1e-9, 6) AS early_share
FROM counted GROUP BY series_id UNION ALL
SELECT 'Overall', count(*), round(avg(CASE WHEN early_purged_raw THEN 1 ELSE 0 END) + 1e-9, 6) FROM counted""",
        ),
        "missing_slots": on_seen(
            all_counts("cbw"),
            f""", d AS (SELECT count(*) AS dropped_records FROM cbw_placed WHERE dropped),
parts AS (SELECT *, true AS is_all FROM ({missing() % "'all_windows'"})
  UNION ALL SELECT *, false FROM ({missing(f"series_id = '{THREE_LABEL}'") % "'three_phase'"})
  UNION ALL SELECT *, false FROM ({missing(f"series_id <> '{THREE_LABEL}'") % "'single_phase'"}))
SELECT * EXCLUDE (is_all, dropped_records),
  CASE WHEN is_all THEN missing_by_count - dropped_records END AS missing_by_count_minus_dropped,
  CASE WHEN is_all THEN missing_by_slots - dropped_records END AS missing_by_slots_minus_dropped FROM parts, d""",
        ),
        "incomplete_samples": on_seen(
            all_counts("cbw"),
            f"""SELECT {KEY}, {EXPECTED} AS expected, final_count, distinct_slot_count,
  {EXPECTED} - distinct_slot_count AS missing_distinct_slots FROM counted WHERE distinct_slot_count < {EXPECTED}
ORDER BY window_start_ms, meter_id, series_id, mode LIMIT 10""",
        ),
        "dropped_ratio": on_seen(
            f"{placed('sw', 'sw_placed')},{placed('cbw', 'cbw_placed')}",
            " UNION ALL ".join(
                f"""SELECT '{MODES[n].lower()}' AS mode, '{label}' AS method_label, {rank} AS method_order,
  count(*) FILTER (WHERE dropped) AS dropped_records, count(*) AS post_filter_total_events,
  round(count(*) FILTER (WHERE dropped) / CAST(count(*) AS DOUBLE) + 1e-9, 6) AS dropped_record_ratio FROM {n}_placed"""
                for n, label, rank in (("sw", "SW", 0), ("cbw", "CBW", 3))
            ),
        ),
        "faulty_summary": on_seen(
            all_faulty("alw", "cbw"),
            f""", per_meter AS (SELECT experiment, meter_id, count(*) AS n FROM faulty GROUP BY ALL),
p95 AS (SELECT experiment, {pct('n', 0.95, 'p')} FROM per_meter GROUP BY experiment)
SELECT f.experiment, count(*) AS faulty_windows, count(DISTINCT meter_id) AS unique_faulty_meters,
  count(DISTINCT meter_id) FILTER (WHERE series_id = '{L1}') AS single_phase_unique_faulty_meters,
  count(DISTINCT meter_id) FILTER (WHERE series_id = '{THREE_LABEL}') AS three_phase_unique_faulty_meters,
  round(count(*) / CAST(count(DISTINCT meter_id) AS DOUBLE) + 1e-9, 6) AS faulty_windows_per_meter_mean,
  max(p) AS faulty_windows_per_meter_p95 FROM faulty f JOIN p95 USING (experiment) GROUP BY f.experiment""",
        ),
        "top_faulty": on_seen(
            all_faulty("alw", "cbw"),
            """, c AS (SELECT experiment, meter_id, series_id, count(*) AS faulty_windows FROM faulty GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY experiment ORDER BY faulty_windows DESC, meter_id, series_id) AS INTEGER) AS rank
FROM c QUALIFY rank <= 50""",
        ),
        "faulty_per_day": on_seen(
            all_faulty("alw", "cbw"),
            f"SELECT experiment, {start}[1:10] AS day, count(*) AS faulty_windows FROM faulty GROUP BY ALL",
        ),
        "latency_summary": on_seen(
            completeness(),
            f"""{FINALS}
SELECT 'proposed' AS experiment, CAST(count(*) AS BIGINT) AS finalized_windows, {rnd('avg(lat)', 'finalization_latency_mean_min')},
  {pct('lat', 0.5, 'finalization_latency_median_min')}, {pct('lat', 0.95, 'finalization_latency_p95_min')},
  {rnd('avg(saved)', 'latency_reduction_mean_min')}, {pct('saved', 0.5, 'latency_reduction_median_min')},
  {pct('saved', 0.95, 'latency_reduction_p95_min')}, {rnd('avg(latency_reduction_ms / CAST(allowed_lateness_ms AS DOUBLE))', 'latency_reduction_mean_ratio')},
  {pct('latency_reduction_ms / CAST(allowed_lateness_ms AS DOUBLE)', 0.95, 'latency_reduction_p95_ratio')} FROM finals""",
        ),
        "latency_distribution": distribution(True),
        "latency_distribution_by_deadline": distribution(False),
        "latency_quantiles": on_seen(
            completeness(),
            FINALS
            + " UNION ALL ".join(
                f" SELECT CAST({q} AS DOUBLE) AS quantile, round(CAST({q} AS DOUBLE) * 100 + 1e-9, 6) AS window_share_percent, {pct('lat', q, 'finalization_latency_min')} FROM finals"
                for q in (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
            ),
        ),
        "latency_histogram": on_seen(
            completeness(),
            f"""{FINALS},
edge AS (SELECT CAST(ceil((greatest(max(lat), max(allowed), 60) + 60) / 60) AS INTEGER) - 1 AS n_bins, count(*) AS total FROM finals),
grid AS (SELECT unnest(range(n_bins)) AS bin, n_bins, total FROM edge),
h AS (SELECT bin, total, count(lat) AS windows FROM grid LEFT JOIN finals ON least(floor(lat / 60), n_bins - 1) = bin GROUP BY ALL)
SELECT CAST(bin * 60 AS DOUBLE) AS bin_start_min, CAST((bin + 1) * 60 AS DOUBLE) AS bin_end_min, windows,
  {rnd('windows / CAST(total AS DOUBLE)', 'window_share')},
  {rnd('sum(windows) OVER (ORDER BY bin) / CAST(total AS DOUBLE)', 'cumulative_window_share')} FROM h""",
        ),
        "lateness_histogram": lateness_histogram("per_meter", "mode, day"),
        "lateness_histogram_overall": lateness_histogram("post_window_delay", "mode"),
        "lateness_cdf": on_readings(
            f"{late('post_window_delay')},{bins('mode')}",
            f"""SELECT mode, round(i * CAST(0.1 AS DOUBLE), 1) AS percentile,
  CASE WHEN i = 0 THEN CAST(0 AS DOUBLE) ELSE {hist_pct('i * CAST(0.1 AS DOUBLE)')} END AS lateness_min
FROM cum CROSS JOIN (SELECT unnest(range(1001)) AS i) GROUP BY mode, i""",
        ),
        "lateness_overall": lateness_overall(),
        "lateness_hourly": on_readings(
            f"""{late('per_meter_series', 'every')},
late AS (SELECT *, insert_s - insert_s % 3600 AS hour_s FROM every WHERE late_s IS NOT NULL),{bins('mode, hour_s')},{hist_pcts('mode, hour_s')}""",
            f"""
, s AS (SELECT mode, hour_s, count(*) AS count, round(CAST(sum(late_s) AS DOUBLE) / 60.0 / count(*), 4) AS mean_min,
  round(max(late_s) / 60.0, 4) AS max_min FROM late GROUP BY ALL)
SELECT mode, strftime(make_timestamp(hour_s * 1000000), '%Y-%m-%d %H:00') AS hour, count, mean_min, {PCTS}, max_min
FROM s JOIN pcts USING (mode, hour_s)""",
        ),
        "recommended_lateness": on_readings(
            f"{late('post_window_delay')},{bins('mode')}",
            f"SELECT {hist_pct('99')} AS allowed_lateness_min FROM cum",
        ),
        "probe_summary": f"""WITH {PARSED},
kept AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY probe ORDER BY ts_ms, count_in_interval) > 3)
SELECT method_key AS mode, substr(probe, length(method_key) + 2) AS stage, probe, count(*) AS samples,
  CAST(sum(count_in_interval) AS BIGINT) AS total_events, {rnd('sum(interval_ms) / CAST(1000 AS DOUBLE)', 'total_interval_sec')},
  {rnd('sum(count_in_interval) / (sum(interval_ms) / CAST(1000 AS DOUBLE))', 'weighted_avg_eps')},
  {rnd('avg(events_per_second)', 'mean_eps')}, {rnd('min(events_per_second)', 'min_eps')},
  {rate_stats({'p25': 0.25, 'median': 0.5, 'p75': 0.75, 'p90': 0.9, 'p95': 0.95}, 'events_per_second', 'eps')},
  {rnd('max(events_per_second)', 'max_eps')}, {rnd('coalesce(stddev_samp(events_per_second), 0)', 'stddev_eps')},
  {rnd('coalesce(stddev_samp(events_per_second), 0) * 100 / avg(events_per_second)', 'cv_percent')},
  min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms FROM kept GROUP BY method_key, probe""",
        "stage_ratio": f"""WITH {TOTALS}
SELECT method_key AS mode, {rnd('source_throughput_weighted_eps', 'source_eps')},
  {rnd('output_emission_rate_weighted_eps', 'post_window_eps')},
  {rnd('output_emission_rate_weighted_eps / source_throughput_weighted_eps', 'ratio')} FROM totals""",
        "probe_totals": f"""WITH {TOTALS} SELECT method_key, {', '.join(
            f"{rnd(f'{p}_weighted_eps', f'{p}_weighted_eps')}, {rnd(f'{p}_mean_eps', f'{p}_mean_eps')}, {rnd(f'{p}_p95_eps', f'{p}_p95_eps')}, CAST({t} AS BIGINT) AS {t}"
            for p, t in (('source_throughput', 'source_events_total'), ('output_emission_rate', 'output_emitted_events_total')))} FROM totals""",
        "stage_summary": f"""WITH {STAGES}
SELECT method_key, method_label, experiment, time_setting, stage, probe, samples, CAST(total_events AS BIGINT) AS total_events,
  {rnd('duration_sec', 'duration_sec')}, {rnd('duration_min', 'duration_min')}, {rnd('total_interval_sec', 'total_interval_sec')},
  {rnd('weighted', 'weighted_avg_events_per_sec')}, {rnd('mean_eps', 'mean_events_per_sec')},
  {rnd('p50', 'median_events_per_sec')}, {', '.join(rnd(p, f'{p}_events_per_sec') for p in ('p05', 'p25', 'p75', 'p95', 'p99'))},
  {rnd('min_eps', 'min_events_per_sec')}, {rnd('max_eps', 'max_events_per_sec')}, {rnd('std_eps', 'std_events_per_sec')},
  {rnd('std_eps / mean_eps', 'cv_events_per_sec')}, first_ts_ms, last_ts_ms FROM stages""",
        "stage_progress": f"""WITH {staged(2)}
SELECT experiment, stage, CAST(sample_index AS INTEGER) AS sample_index, ts_ms, {rnd('elapsed_sec', 'elapsed_sec')},
  {rnd('elapsed_sec / CASE WHEN longest > 0 THEN longest ELSE 1 END * 100', 'runtime_percent')} FROM staged""",
        "throughput_overall": f"""WITH {OVERALL}
SELECT experiment, method_key, method_label, time_setting, CAST(total_events AS BIGINT) AS post_filter_total_events,
  {rnd('duration_min', 'post_filter_duration_min')}, {rnd('weighted', 'post_filter_weighted_avg_events_per_sec')},
  {rnd('p50', 'post_filter_median_events_per_sec')}, {rnd('p95', 'post_filter_p95_events_per_sec')},
  {rnd('p99', 'post_filter_p99_events_per_sec')}, {rnd('std_eps / mean_eps', 'post_filter_cv_events_per_sec')},
  CAST(source_events AS BIGINT) AS source_total_events, {rnd('source_min', 'source_duration_min')},
  {rnd('source_eps', 'source_weighted_avg_events_per_sec')},
  {rnd('total_events / CAST(source_events AS DOUBLE) * 100', 'post_filter_source_event_ratio_pct')},
  {rnd('(duration_min / b_min - 1) * 100', 'runtime_vs_baseline_pct')}, {rnd('(weighted / b_eps - 1) * 100', 'post_filter_eps_vs_baseline_pct')},
  {rnd('(b_min / duration_min - 1) * 100', 'speedup_vs_baseline_pct')}, {rnd('(duration_min / p_min - 1) * 100', 'runtime_vs_proposed_pct')},
  {rnd('(weighted / p_eps - 1) * 100', 'post_filter_eps_vs_proposed_pct')}, {ORDER} AS method_order FROM overall, base""",
        "throughput_ranking": f"""WITH {OVERALL} SELECT experiment, method_label,
  {rnd('weighted', 'post_filter_weighted_avg_events_per_sec')} FROM overall""",
        "runtime_curve": f"""WITH {staged()}
SELECT method_key, method_label, experiment, stage, floor(elapsed_sec / 86400) * 86400 AS elapsed_bucket_sec,
  {rnd('avg(elapsed_sec)', 'elapsed_sec')}, {rnd('avg(elapsed_sec / 60)', 'elapsed_min')},
  {rnd('avg(elapsed_sec / CASE WHEN longest > 0 THEN longest ELSE 1 END * 100)', 'runtime_percent')},
  {rnd('avg(events_per_second)', 'mean_events_per_sec')}, {pct('events_per_second', 0.5, 'median_events_per_sec')},
  {pct('events_per_second', 0.95, 'p95_events_per_sec')}, count(*) AS samples
FROM staged GROUP BY method_key, method_label, experiment, stage, floor(staged.elapsed_sec / 86400)""",
        "nearest_pairs": f"""WITH {pairs()}
SELECT method_key, method_label, experiment, post_filter_ts_ms, source_ts_ms, timestamp_delta_ms,
  {rnd('elapsed_sec', 'elapsed_sec')}, {rnd('elapsed_min', 'elapsed_min')}, {rnd('source_events_per_sec', 'source_events_per_sec')},
  {rnd('post_filter_events_per_sec', 'post_filter_events_per_sec')}, {rnd('throughput_ratio', 'throughput_ratio')},
  {rnd('1 - throughput_ratio', 'filter_drop_ratio')}, source_count, post_filter_count FROM pairs""",
        "ratio_summary": f"""WITH {pairs()}
SELECT method_key, method_label, experiment, count(*) AS paired_samples, {rnd('avg(p)', 'mean_ratio_pct')},
  {pct('p', 0.5, 'median_ratio_pct')}, {pct('p', 0.05, 'p05_ratio_pct')}, {pct('p', 0.95, 'p95_ratio_pct')},
  {rnd('min(p)', 'min_ratio_pct')}, {rnd('max(p)', 'max_ratio_pct')},
  {rnd('avg(abs(timestamp_delta_ms))', 'mean_abs_timestamp_delta_ms')} FROM pairs GROUP BY ALL""",
        "ratio_curve": f"""WITH {pairs()}
SELECT method_key, method_label, experiment, floor(elapsed_sec / 86400) * 86400 AS elapsed_bucket_sec,
  {rnd('avg(elapsed_sec)', 'elapsed_sec')}, {rnd('avg(elapsed_min)', 'elapsed_min')}, {rnd('avg(throughput_ratio) * 100', 'mean_ratio_pct')},
  {rnd('quantile_cont(throughput_ratio, 0.5) * 100', 'median_ratio_pct')}, count(*) AS samples
FROM pairs GROUP BY method_key, method_label, experiment, floor(pairs.elapsed_sec / 86400)""",
        "cpu_buckets": f"""WITH {series()}
SELECT experiment, CAST(floor(elapsed_sec / 86400) AS INTEGER) AS bucket, {rnd('avg(elapsed_sec / 60)', 'elapsed_min')},
  {', '.join(pct('cpu_percent', s, f'cpu_{n}') for n, s in (('median', 0.5), ('p95', 0.95), ('p25', 0.25), ('p75', 0.75)))},
  count(*) AS samples FROM series GROUP BY experiment, floor(elapsed_sec / 86400)""",
        "memory_buckets": f"""WITH {series(warmup='(ts_ms - t0) >= 86400000')}
SELECT experiment, CAST(floor(elapsed_sec / 86400) AS INTEGER) AS bucket, {rnd('avg(elapsed_sec / 60)', 'elapsed_min')},
  {rnd('avg(memory)', 'memory_mean')}, {rnd('max(memory)', 'memory_max')}, {pct('memory', 0.95, 'memory_p95')},
  count(*) AS samples FROM series GROUP BY experiment, floor(elapsed_sec / 86400)""",
        "runtime_bins": f"""WITH {series(where='cpu_percent > 0 AND memory > 0')},
b AS (SELECT *, least(floor(elapsed_sec / longest * 100 / 5) * 5, 100) AS pct_bin FROM series)
SELECT experiment, CAST(pct_bin AS DOUBLE) AS runtime_percent, {pct('cpu_percent', 0.95, 'cpu_usage')},
  {pct('memory', 0.5, 'memory_usage_mib')}, count(*) AS samples FROM b GROUP BY ALL""",
        "system_summary": f"""WITH {SYSTEM} SELECT experiment, {', '.join(rnd(c, c) for c in (
            'runtime_sec', 'runtime_min', 'cpu_mean_percent', 'cpu_p95_percent', 'cpu_peak_percent', 'memory_mean_mib',
            'memory_p95_mib', 'memory_peak_mib'))}, system_samples, {rnd('threads_p95', 'threads_p95')} FROM system_rows""",
        "performance_comparison": comparison(),
        "metric_table": f"""WITH {SYSTEM},
long AS (SELECT experiment, 'runtime_sec' AS metric, 'sec' AS unit, runtime_sec AS v FROM system_rows
  UNION ALL SELECT experiment, 'cpu_mean_percent', '%', cpu_mean_percent FROM system_rows
  UNION ALL SELECT experiment, 'memory_p95_mib', 'MiB', memory_p95_mib FROM system_rows),
wide AS (SELECT metric, unit, {', '.join(f"max(v) FILTER (WHERE experiment = '{m}') AS {m}" for m in ('fast', 'delayed', 'baseline', 'proposed'))}
  FROM long GROUP BY ALL)
SELECT 'system' AS category, metric, unit, {', '.join(rnd(m, m) for m in ('fast', 'delayed', 'baseline', 'proposed'))},
  {rnd('proposed - baseline', 'delta_proposed_vs_baseline')},
  {rnd('(proposed - baseline) / nullif(baseline, 0) * 100', 'delta_pct_proposed_vs_baseline')} FROM wide""",
        "smoothed_cpu": f"""WITH {series()}
SELECT experiment, ts_ms, {rnd('avg(cpu_percent) OVER (PARTITION BY experiment ORDER BY ts_ms ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)', 'cpu_percent_smooth', 5)},
  {rnd('elapsed_sec / longest * 100', 'progress_pct', 5)} FROM series""",
        "sampling_interval": f"""WITH {series()},
g AS (SELECT experiment, (ts_ms - lag(ts_ms) OVER (PARTITION BY experiment ORDER BY ts_ms)) / CAST(1000 AS DOUBLE) AS gap FROM series)
SELECT experiment, {pct('gap', 0.5, 'median_interval_sec')} FROM g GROUP BY experiment""",
    }
    sql["meter_class_totals"] = f"SELECT class, count(*) AS meters FROM ({sql['meter_classes']}) GROUP BY class"
    for mode, name in (
        ("per_meter", "per_meter"),
        ("per_meter_series", "per_meter_series"),
        ("global", "global"),
        ("post_window_delay", "post_window"),
    ):
        sql[f"lateness_{name}"] = lateness_rows(mode)
    sql["lateness_days_per_meter"] = lateness_days("per_meter")
    sql["lateness_days_post_window"] = lateness_days("post_window_delay")
    modes = ("per_meter", "per_meter_series", "post_window_delay")
    sql["lateness_days_carried"] = " UNION ALL ".join(f"SELECT * FROM ({lateness_days(m)})" for m in modes)
    for name in POLICIES:
        sql[f"window_counts_{name}"] = on_seen(
            placed(name),
            f"""SELECT {GROUP}, count(*) FILTER (WHERE NOT late AND NOT dropped) AS on_time,
  count(*) FILTER (WHERE late AND NOT dropped) AS late_taken, count(*) FILTER (WHERE NOT dropped) AS taken,
  count(*) FILTER (WHERE dropped) AS dropped FROM placed GROUP BY ALL""",
        )
        sql[f"emissions_{name}"] = on_seen(emissions(name), "SELECT * FROM emissions")
        sql[f"output_counts_{name}"] = output_counts(name)
    for name in ("alw", "cbw"):
        sql[f"faulty_windows_{name}"] = faulty_windows(name)
    sql |= text_lines()
    return sql | {"metric_table_all": metric_table_all(sql)}
