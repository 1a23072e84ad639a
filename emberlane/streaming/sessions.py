"""The session scan as a stream: flags with a lifetime in steps and seconds, kept as state per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlane.functions import parsing, prefilter, rules, text

OUTPUT = "session_id long, step long, active string, risk double, combo string, triggers int, decision string"
STATE = "seen string, counts string, goal string, trusted string"


def riskiest(active: set[str], new: set[str]) -> tuple[float, int, str, int] | None:
    """The riskiest combination of active flags that a new one belongs to (of equal ones the first): risk, order, name, threshold."""
    hits = [(risk, -i, name, need) for i, (flags, risk, name, need) in enumerate(rules.COMBOS) if active.issuperset(flags) and not new.isdisjoint(flags)]
    return max(hits, default=None)


def scan_sessions(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Streaming input with ``session_id, step, ts, action, action_type, event_time``; one row per step as it arrives, as the batch scan has it.

    Flags and addresses are found by the engine; only what a step changes in its session is kept as state: when each flag was last
    seen, how often each combination fired, the user's goal, and what trusted tools have given. State expires by event time once no
    step can bring it back; rows later than the watermark are dropped.
    """
    import json

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, counts, goal, trusted = (json.loads(x) for x in state.get) if state.exists else ({}, {}, None, [])
        trusted = set(trusted)
        rows = pd.concat(list(batches)).sort_values("step")
        out = []
        for r in rows.itertuples():
            if goal is None and r.action_type == "prompt":
                goal = r.action
            gone = {f for f, (step, ts) in seen.items() if r.step - step > rules.FLAG_STEPS or r.ts - ts > rules.FLAG_SECONDS}
            seen = {f: at for f, at in seen.items() if f not in gone}
            counts = {c: n for c, n in counts.items() if gone.isdisjoint(FLAGS_OF[c])}
            new = set(r.flags)
            target = next((t for t in r.targets if t not in (goal or "")), None)
            if target is not None and target not in trusted:
                new.add("suspicious_target")
            if r.trusted:
                trusted.update(r.tokens)
            seen.update({f: (int(r.step), int(r.ts)) for f in new})
            hit, n, risk = riskiest(set(seen), new), 0, 0.0
            if hit:
                n = counts[hit[2]] = counts.get(hit[2], 0) + 1
                risk = 0.85 if hit[0] < 0.85 and n >= hit[3] else hit[0]
            decision = "ALLOW" if not hit else "BLOCK" if risk >= 0.85 else "MONITOR"
            out.append((key[0], r.step, ",".join(sorted(seen)), risk, hit[2] if hit else None, n, decision))
        state.update(tuple(json.dumps(x) for x in (seen, counts, goal, sorted(trusted))))
        last = int(rows["ts"].max() + rules.FLAG_SECONDS) * 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    found = F.concat(F.regexp_extract_all("action", F.lit(prefilter.bounds(f"({rules.EMAIL})")), F.lit(1)), F.regexp_extract_all("action", F.lit(f"({rules.URL})"), F.lit(1)))
    exempt = F.lower("action").rlike("|".join(rules.COLLABORATION_TOOLS)) & ~F.lower("action").rlike(prefilter.bounds(rules.SENSITIVE_OR_HIJACK))
    tool = F.regexp_extract("action", r"^([A-Za-z_]\w*)\(", 1)
    flagged = events.withWatermark("event_time", watermark).withColumn("_form", text.pre_normalise(parsing.envelope(F.col("action")))).withColumn("tokens", found)
    flagged = flagged.select(
        "session_id", "step", "ts", "event_time", "action", "action_type", "tokens", rules.extract_flags(F.col("_form")).alias("flags"),
        F.when(exempt, F.array().cast("array<string>")).otherwise(F.col("tokens")).alias("targets"), tool.isin(*rules.TRUSTED_TOOLS).alias("trusted"),
    )
    return flagged.groupBy("session_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


FLAGS_OF = {name: set(flags) for flags, _, name, _ in rules.COMBOS}


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts per event type with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event_type", "n")
