"""What live queries remember: of a run its state and waiting events, of a log file its length and findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATES = "investigation_id string, state string, illegal_transitions bigint, disordered bigint, waiting bigint, phase string, micros bigint"
FINDINGS = "case_id string, file string, indicator string, match_count bigint, first_line bigint, last_line bigint"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the store that knows lists, maps and timers; new queries of the session use it from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _micros(at: pd.Series) -> list[int | None]:
    return [None if pd.isna(t) else t.value // 1000 for t in at]


class RunStates(StatefulProcessor):
    """Applies a run's transitions in order of their ids once the watermark has passed them."""

    def __init__(self, legal: set[str], dropped: set[str]):
        self.legal, self.dropped = legal, dropped

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, entered bigint, last bigint, illegal bigint, disordered bigint")
        self.phases = handle.getMapState("phases", "phase string", "micros bigint")
        self.waiting = handle.getListState("waiting", "event_id bigint, at bigint, to_state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, entered, last, illegal, disordered = self.now.get() if self.now.exists() else (None, None, None, 0, 0)
        come = []
        for batch in rows:
            illegal += sum(f"{a}>{b}" not in self.legal for a, b in zip(batch["from_state"], batch["to_state"]))
            for event, at, to in zip(batch["event_id"].tolist(), _micros(batch["at"]), batch["to_state"]):
                if at is None:
                    continue
                if last is not None and event <= last:
                    disordered += 1
                else:
                    come.append((event, at, to or ""))  # a missing state is kept as an empty one
        waiting = sorted([*self._listed(), *come])
        return self._settled(key, (state, entered, last, illegal, disordered), waiting, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._settled(key, self.now.get(), sorted(self._listed()), timerValues)

    def _listed(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def _settled(self, key, now: tuple, waiting: list[tuple], timers) -> Iterator[pd.DataFrame]:
        state, entered, last, illegal, disordered = now
        passed = timers.getCurrentWatermarkInMs() * 1000
        done = 0
        while done < len(waiting) and waiting[done][1] <= passed:  # in order of ids: what follows one that must wait waits too
            done += 1
        phases = {k[0]: v[0] for k, v in self.phases.iterator()} if self.phases.exists() else {}
        state, entered, phases = _applied(state, entered, phases, waiting[:done])
        if done:
            last = waiting[done - 1][0]
            for phase, micros in phases.items():
                self.phases.updateValue((phase,), (micros,))
        waiting = waiting[done:]
        if not waiting and state in self.dropped:
            for kept in (self.now, self.phases, self.waiting):
                kept.clear()
        else:
            self.now.update((state, entered, last, illegal, disordered))
            if waiting:
                self.waiting.put(waiting)
            else:
                self.waiting.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if waiting:
                self.handle.registerTimer(waiting[0][1] // 1000 + 1)
        state, _, phases = _applied(state, entered, phases, waiting)
        listed = sorted(phases.items()) or [(None, None)]
        yield pd.DataFrame(
            {
                "investigation_id": key[0], "state": state or None, "illegal_transitions": illegal, "disordered": disordered, "waiting": len(waiting),
                "phase": [p or None for p, _ in listed], "micros": pd.array([m for _, m in listed], dtype="Int64"),
            }
        )


def _applied(state: str | None, entered: int | None, phases: dict[str, int], events: list[tuple]) -> tuple[str | None, int | None, dict[str, int]]:
    """State, when it was entered, and time per phase (in microseconds) after the events."""
    phases = dict(phases)
    for _, at, to in events:
        if entered is not None:
            phases[state] = phases.get(state, 0) + at - entered
        state, entered = to, at
    return state, entered, phases


class FileFindings(StatefulProcessor):
    """Counts a file's lines from batch to batch, and gives the findings that new lines changed."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = {"ttlDurationMs": ttl_ms} if ttl_ms else {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.length = handle.getValueState("length", "lines bigint")
        self.found = handle.getMapState("found", "indicator string", "count bigint, first bigint, last bigint", **self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.length.get()  # none yet: nothing
        length = known[0] if known else 0
        changed: dict[str, list[int]] = {}
        for part in sorted((r for batch in rows for r in batch.itertuples()), key=lambda r: r.part):
            for hit in part.found:
                line = length + hit["pos"] + 1
                for indicator in hit["named"]:
                    one = changed.setdefault(indicator, [0, line, line])
                    one[0] += 1
                    one[2] = line
            length += part.lines
        self.length.update((length,))
        for indicator, new in changed.items():
            if self.found.containsKey((indicator,)):
                count, first, _ = self.found.getValue((indicator,))
                new[:2] = new[0] + count, first
            self.found.updateValue((indicator,), tuple(new))
        listed = [(*key, indicator, *new) for indicator, new in changed.items()]
        if listed:
            yield pd.DataFrame(listed, columns=["case_id", "file", "indicator", "match_count", "first_line", "last_line"])
