"""The window policies one record at a time, in plain Python, for small inputs."""

from __future__ import annotations

from finality.config import SINGLE, THREE, VOLTAGE_SERIES, Policy, WindowSpec

END = 9_223_372_036_854_775_807


def zero_run(points, phase, spec):
    run = 0
    for _, _, value, _ in sorted(p for p in points if p[3] == phase):
        run = run + 1 if abs(value) <= spec.zero_tolerance else 0
        if run >= spec.zero_run:
            return True
    return False


def is_faulty(group, points, spec):
    return all(zero_run(points, p, spec) for p in ((0, 1, 2) if group == THREE else (0,)))


def text(group, points):
    parts = []
    for phase in (0, 1, 2) if group == THREE else (0,):
        values = ";".join(f"{v:.3f}" for _, _, v, p in sorted(points) if p == phase)
        parts.append(f"{VOLTAGE_SERIES[phase]}=[{values}]")
    return "|".join(parts)


def slots(group, points, spec):
    keys = set()
    for event, _, _, phase in points:
        slot = (event % spec.size_ms) // spec.slot_ms
        keys.add(slot * 3 + phase if group == THREE else slot)
    return len(keys)


def simulate(readings: list[dict], policy: Policy, spec: WindowSpec):
    """Emissions and the arrival numbers of dropped readings."""
    windows: dict[tuple, dict] = {}
    emitted, dropped = [], []
    top = None

    def fire(key, state, why, watermark, seq, phase):
        group, meter, start = key
        state["emitted"] += 1
        points = state["points"]
        faulty = is_faulty(group, points, spec)
        row = {
            "phase_group": group,
            "meter_id": meter,
            "window_start_ms": start,
            "emit_no": state["emitted"],
            "count": len(points),
            "why": why,
            "fault": faulty,
            "text": text(group, points) if faulty else None,
            "fire_seq": seq,
            "fire_phase": phase,
        }
        if policy.completes_early:
            end = start + spec.size_ms
            passed = 0 if watermark is None else watermark - end
            row["slots"] = slots(group, points, spec)
            row["latency"] = (
                None if why == "PRELIMINARY" else max(0, min(policy.lateness_ms, passed))
            )
            row["watermark"] = None if why == "PRELIMINARY" else watermark
        emitted.append(row)

    def timers(seq):
        limit = None if top is None else top - policy.delay_ms
        for key, state in sorted(windows.items(), key=lambda item: (item[0][2], item[0])):
            end = key[2] + spec.size_ms
            if state["done"] or not state["points"]:
                continue
            due = end + policy.lateness_ms if policy.completes_early else end
            if seq == END or (limit is not None and limit >= due):
                watermark = END if seq == END else limit - 1
                fire(key, state, "DEADLINE" if policy.completes_early else "CLOSE", watermark, seq, 1)
                state["done"] = True

    for r in readings:
        limit = None if top is None else top - policy.delay_ms
        start = r["event_ms"] // spec.size_ms * spec.size_ms
        end = start + spec.size_ms
        if r["phase_group"] is not None:
            if limit is not None and limit >= end + policy.lateness_ms:
                dropped.append(r["arrival_seq"])
            else:
                key = (r["phase_group"], r["meter_id"], start)
                state = windows.setdefault(key, {"points": [], "emitted": 0, "done": False})
                point = (r["event_ms"], r["arrival_seq"], r["value"], VOLTAGE_SERIES.index(r["series_id"]))
                if policy.completes_early:
                    if not state["done"]:
                        state["points"].append(point)
                        full = spec.expected_for(key[0])
                        watermark = None if limit is None else limit - 1
                        if len(state["points"]) == full:
                            fire(key, state, "COMPLETENESS", watermark, r["arrival_seq"], 0)
                            state["done"] = True
                        elif len(state["points"]) == spec.preliminary_for(key[0]):
                            fire(key, state, "PRELIMINARY", watermark, r["arrival_seq"], 0)
                else:
                    state["points"].append(point)
                    if limit is not None and limit >= end:
                        state["done"] = True
                        fire(key, state, "UPDATE", None, r["arrival_seq"], 0)
        if top is None or r["event_ms"] > top:
            top = r["event_ms"]
            timers(r["arrival_seq"])
    timers(END)
    return emitted, dropped


def random_readings(rng, count: int, meters: int, span_ms: int, jitter_ms: int, step_ms: int = 1):
    """Readings whose event time trails their arrival by a random delay."""
    rows = []
    for seq in range(count):
        meter = rng.randrange(meters) if rng.random() < 0.6 else 0
        group = THREE if meter % 2 else SINGLE
        series = rng.choice(VOLTAGE_SERIES)
        event = seq * span_ms // count - rng.randrange(jitter_ms) - span_ms // 3
        rows.append(
            {
                "arrival_seq": seq * 3,
                "arrival_epoch": seq // 50,
                "meter_id": f"m{meter}",
                "series_id": series,
                "event_ms": event // step_ms * step_ms,
                "value": rng.choice([0.0, 0.0, 0.001, 0.0011, 1.5]),
                "insert_ms": seq * 1000,
                "phase_group": group if group == THREE or series == VOLTAGE_SERIES[0] else None,
            }
        )
    return rows


SCHEMA = (
    "arrival_seq bigint, arrival_epoch bigint, meter_id string, series_id string, "
    "event_ms bigint, value double, insert_ms bigint, phase_group string"
)
