"""Small telemetry fixtures and a brute-force model of window semantics."""

from collections import Counter

from tracemill.schemas import FEATURES, GRAMS, OPERATIONS, TELEMETRY

SECOND = 1_000_000_000
LENGTH = 10 * SECOND


def row(kind, sequence, at=None, **fields):
    base = {name: None for name in TELEMETRY.names}
    base.update(type=kind, run_id="r", recording="f", collector_sequence=sequence, pos=sequence, timestamp_ns=at)
    base.update(fields)
    return base


def event(sequence, at, operation="O", process=1, result=0, lost=0, **fields):
    return row("event", sequence, at, boot_id="b", tgid=process, start_time_ns=7, tid=process, operation=operation,
               result=result, lost_events=lost, filename="x", **{"telemetry_quality": "complete", **fields})


def beat(sequence, at, lost=0, **fields):
    return row("heartbeat", sequence, at, lost_events=lost, **fields)


def gone(sequence, at, process=1, **fields):
    return row("process_exit", sequence, at, boot_id="b", tgid=process, start_time_ns=7, tid=process, **fields)


def arriving(*records):
    """Give records their list order as arrival position; sequences stay as they are."""
    return [{**record, "pos": index} for index, record in enumerate(records, start=1)]


def frame(spark, records):
    return spark.createDataFrame([tuple(r[name] for name in TELEMETRY.names) for r in records], TELEMETRY)


def bounds(spark, start, end):
    return spark.createDataFrame([("r", start, end)], "run_id string, capture_start_ns bigint, capture_end_ns bigint")


def by_definition(records, start, end, length=LENGTH, bucket=SECOND):
    """Windows straight from the definitions, by looking at every pair of records."""
    records = sorted(records, key=lambda r: r["pos"])
    mark = [max([start] + [r["timestamp_ns"] for r in records[:i + 1]]) for i in range(len(records))]

    def slot(at):
        return start + (at - start) // length * length

    good = [(i, r) for i, r in enumerate(records)
            if r["type"] == "event" and (r["result"] is None or r["result"] >= 0)]
    keys = {(r["tgid"], slot(r["timestamp_ns"])) for _, r in good}
    result = {}
    for process, begin in keys:
        mine = [(i, r) for i, r in good if (r["tgid"], slot(r["timestamp_ns"])) == (process, begin)]
        exits = [i for i, r in enumerate(records) if r["type"] == "process_exit" and r["tgid"] == process
                 and slot(mark[i]) == begin and i > mine[0][0]]
        late = sum(begin + length <= mark[i] or (bool(exits) and i > exits[0]) for i, _ in mine)
        loss = 0
        for r in records:
            if r["lost_events"]:
                at = r["timestamp_ns"]
                edge = at > start and (at - start) % length == 0
                loss += r["lost_events"] if slot(at - 1 if edge else at) == begin else 0
        text = "".join(r["operation"] for _, r in sorted(mine, key=lambda p: p[1]["collector_sequence"]))
        grams = Counter(text[i:i + 3] for i in range(len(text) - 2))
        values = [text.count(op) for op in OPERATIONS]
        for op in OPERATIONS:
            peaks = Counter((r["timestamp_ns"] - begin) // bucket for _, r in mine if r["operation"] == op)
            values.append(max(peaks.values(), default=0))
        values += [grams[g] for g in GRAMS]
        partial = bool(exits) or begin + length > max([end] + mark)
        result[process, begin] = (dict(zip(FEATURES, values)), partial, loss, late)
    return result


def collected(windows):
    return {
        (r["tgid"], r["start_ns"]): (
            {name: r[name] for name in FEATURES}, r["partial"], r["loss_count"], r["late_event_count"])
        for r in windows.collect()
    }
