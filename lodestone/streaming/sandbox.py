"""Sandbox checks of preview sessions as a stream: ordered phases, bounded repair attempts, one last row a session.

Input rows: session, ord (from 0, gapless), kind, file, status, checks (names of failed ones), at. Kinds: `patch` (a file
that changes), `verify` (the first check's status; later ones are left out), `repair` (an attempt's status; checks that still fail after it),
`repaired` (a file that an attempt mended). A session's rows are taken in order of ord whenever they arrive: what
comes early waits in the session's list state. A session that has said nothing for `ttl` seconds of event time ends
with an error. Its value state (a few numbers) stays until then, so rows after its last one are known and left out.

Output: session, place, event, message, attempt, files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.progress import SESSION_TTL

OUTPUT = "session string, place int, event string, message string, attempt int, files array<string>"
#: States of a check that end a session well, and of a repair attempt after which there may be another.
PASSING, REPAIRING = ("passed", "skipped"), ("success", "partial")
_WAITING = "ord int, kind string, file string, status string, checks string"
#: What each event says.
SAYS = {
    "nothing": "No file changes to verify.", "clean": "Sandbox checks passed — all proposed changes are clean.", "verified": "All changes verified. Review the diffs and apply when ready.",
    "off": "Auto-repair disabled. Diffs shown as-is — review carefully.", "reading": "Repair Agent reading errors…", "mended": "Repair succeeded — diffs updated with fixes.",
    "all_mended": "All changes verified and repaired. Review the diffs and apply when ready.", "not_mended": "Repair could not resolve all issues — review diffs carefully.",
    "some_left": "Some issues remain after repair. Review the diffs carefully before applying.", "expired": "Preview session expired.",
}


class SandboxSessions(StatefulProcessor):
    """One session's phases. auto_repair and attempts: whether and how often a failed check is repaired."""

    def __init__(self, attempts: int, auto_repair: bool, ttl: int) -> None:
        self.attempts, self.auto_repair, self.ttl = max(1, attempts), auto_repair, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "next int, place int, files int, attempt int, closed boolean, alarm long")
        self.waiting = handle.getListState("waiting", _WAITING)
        self.mended = handle.getListState("mended", "file string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, place, files, attempt, closed, alarm = self.state.get() if self.state.exists() else (0, 0, 0, 0, False, 0)
        early = {r[0]: r[1:] for r in self.waiting.get()}
        newest = 0
        for batch in rows:
            newest = max(newest, int(batch["at"].astype("datetime64[us]").astype("int64").max()) // 1000)
            for r in batch.itertuples(index=False):
                if r.ord >= at:
                    early.setdefault(int(r.ord), (r.kind, r.file, r.status, r.checks))
        out = []

        def say(event: str, message: str, files: list[str] | None = None) -> None:
            nonlocal place, closed
            out.append((key[0], place, event, message, attempt or None, files))
            place, closed = place + 1, closed or event in ("done", "error")

        while at in early:
            kind, file, status, checks = early.pop(at)
            at += 1
            if closed:
                continue
            if kind == "patch":
                files += 1
            elif kind == "repaired":
                self.mended.appendValue((file,))
            elif kind == "verify" and not attempt:
                if not files:
                    say("done", SAYS["nothing"])
                    continue
                say("phase", f"Sandbox-checking {files} changed file(s) across all packages…")
                if status in PASSING:
                    say("verify_done", SAYS["clean"])
                    say("done", SAYS["verified"])
                    continue
                say("verify_fail", f"Checks failed ({checks or ''}) — running auto-repair on sandbox…")
                if not self.auto_repair:
                    say("done", SAYS["off"])
                    continue
                say("phase", SAYS["reading"])
                attempt = 1
                say("repair_attempt", f"Repair attempt {attempt}/{self.attempts}…")
            elif kind == "repair" and attempt:
                if not checks:
                    say("repair_done", SAYS["mended"], sorted({x[0] for x in self.mended.get()}))
                    say("done", SAYS["all_mended"])
                elif status in REPAIRING and attempt < self.attempts:
                    attempt += 1
                    self.mended.clear()
                    say("repair_attempt", f"Repair attempt {attempt}/{self.attempts}…")
                else:
                    say("repair_fail", SAYS["not_mended"])
                    say("done", SAYS["some_left"])
        self.waiting.clear()
        if closed:
            self.mended.clear()
        elif early:
            self.waiting.put([(i, *x) for i, x in early.items()])
        due = max(newest + self.ttl * 1000, timerValues.getCurrentWatermarkInMs() + 1)
        if due > alarm:
            if alarm:
                self.handle.deleteTimer(alarm)
            self.handle.registerTimer(due)
            alarm = due
        self.state.update((at, place, files, attempt, closed, alarm))
        yield _rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, place, _, attempt, closed, _ = self.state.get()
        for state in (self.state, self.waiting, self.mended):
            state.clear()
        yield _rows([] if closed else [(key[0], place, "error", SAYS["expired"], attempt or None, None)])

    def close(self) -> None:
        pass


def _rows(out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["session", "place", "event", "message", "attempt", "files"])
    return frame.astype({"place": "int32", "attempt": "Int32"})


def sandbox_phases(rows: DataFrame, attempts: int = 1, auto_repair: bool = True, ttl: int = SESSION_TTL, late: str = "10 minutes") -> DataFrame:
    """The phases of every session, as a stream (append). Its state store has to be RocksDB."""
    timed = rows.select("session", F.col("ord").cast("int").alias("ord"), "kind", "file", "status", "checks", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("session").transformWithStateInPandas(SandboxSessions(attempts, auto_repair, ttl), OUTPUT, "Append", "EventTime")
