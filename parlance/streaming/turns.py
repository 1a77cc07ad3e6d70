"""Turns of live channels: sections, speakers and merged texts by state that doesn't grow with a section.

Messages wait in state until the watermark has passed them, and are then taken in id order. They
wait in runs, each sorted by id and cut into parts of PART messages, and runs are merged part by part, so
a task holds a part of each run, however many messages a channel sends in one batch. Batches in the order of ids
go on with the run before. State is read and written a part at a time, never a message at a time: speakers and texts
are kept by the task while it takes messages, speakers up to KNOWN of them, and put into state at its end. What is
kept besides is the open section's number, its last time, the speakers seen in it, and the open
turn's text. A turn is given once another speaker, or a timer `gap` seconds after the section's last
message, has closed it. What comes after the watermark has passed its time is late and is given apart.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parlance.functions import text as T
from parlance.operators.sessions import GAP_SECONDS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "channel string, section long, turn_idx long, person_id long, text string, late boolean, id long"
_COLUMNS = [c.split(" ")[0] for c in OUT.split(", ")]
#: Messages of a part, rows that are given at once, and speakers that a task knows without the state.
PART, GIVEN, KNOWN = 256, 5000, 10_000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({c: "Int64" for c in ("section", "turn_idx", "person_id", "id")})


class _Turns(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("runs", "run long, part long", "ids array<long>, ts array<long>, authors array<string>, bots array<boolean>, texts array<string>")
        #: The next run's number and the least time that waits.
        self.runs = handle.getValueState("next_run", "run long, least long")
        self.place = handle.getValueState("place", "section long, last long, turn long, person long, people long")
        self.people = handle.getMapState("people", "author string", "person long")
        self.said = handle.getListState("said", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        end = None
        for frame in rows:
            late, new = [], []
            for id_, ts, author, bot, text in zip(frame["id"].tolist(), frame["ts_secs"].tolist(), frame["author"], frame["bot"].tolist(), frame["text"], strict=True):
                if ts * 1000 < passed:
                    late.append((key[0], None, None, None, text, True, id_))
                else:
                    new.append((id_, ts, author, bot, text))
            end = self._wait(sorted(new, key=lambda m: m[0]), end)
            if late:
                yield _frame(late)
        yield from self._drained(key, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drained(key, timerValues.getCurrentWatermarkInMs())

    def _wait(self, messages: list[tuple], end: tuple | None = None) -> tuple | None:
        """Adds sorted messages to those that wait: to the run that ends so (run, parts, last id) if they follow it, or as a run of their own. Gives that run's end."""
        if not messages:
            return end
        following, least = self.runs.get() if self.runs.exists() else (0, None)
        run, parts = end[:2] if end is not None and end[2] < messages[0][0] else (following, 0)
        for at in range(0, len(messages), PART):
            self.waiting.updateValue((run, parts), tuple(map(list, zip(*messages[at : at + PART], strict=True))))
            parts += 1
        times = [m[1] for m in messages] + ([] if least is None else [least])
        self.runs.update((max(following, run + 1), min(times)))
        return run, parts, messages[-1][0]

    def _taken(self) -> Iterator[tuple]:
        """All messages that wait, by id; a part leaves the state when it is read. Of messages with one id the last to come counts."""
        parts = defaultdict(list)
        for run, part in list(self.waiting.keys()):
            parts[run].append(part)

        def read(run: int) -> Iterator[tuple]:
            for part in sorted(parts[run]):
                columns = self.waiting.getValue((run, part))
                self.waiting.removeKey((run, part))
                for n, message in enumerate(zip(*columns, strict=True)):
                    yield message[0], run, part, n, message

        held = None
        for *_, message in heapq.merge(*map(read, parts), key=lambda x: x[:4]):
            if held is not None and held[0] != message[0]:
                yield held
            held = message
        if held is not None:
            yield held

    def _drained(self, key, passed: int) -> Iterator[pd.DataFrame]:
        """Takes what the watermark has passed, closes the section if its time is over, and sets the next timer."""
        out, wake, pending, known, new = [], [], [], {}, {}
        least = self.runs.get()[1] if self.runs.exists() else None
        section, last, turn, person, people = self.place.get() if self.place.exists() else (0, None, 0, None, 0)
        # whether the state holds texts of the open turn, and speakers of the open section
        said, stored = person is not None and self.said.exists(), people > 0

        def close() -> None:
            nonlocal turn, person, said
            if person is not None:
                before = [x[0] for x in self.said.get()] if said else []
                out.append((key[0], section, turn, person, " ".join(before + pending), False, None))
                if said:
                    self.said.clear()
                    said = False
                pending.clear()
                turn, person = turn + 1, None

        def store() -> None:
            nonlocal stored
            for x, who in new.items():
                self.people.updateValue((x,), (who,))
            stored = stored or bool(new)
            new.clear()

        ready = least is not None and least * 1000 < passed
        if ready:
            self.runs.update((self.runs.get()[0], None))
        left, end = [], None
        for id_, ts, author, bot, text in self._taken() if ready else ():
            if ts * 1000 >= passed:
                left.append((id_, ts, author, bot, text))
                if len(left) >= GIVEN:
                    end = self._wait(left, end)
                    left = []
                continue
            if last is not None and ts - last >= self.gap:
                close()
                section, turn, people = section + 1, 0, 0
                known.clear(), new.clear()
                if stored:
                    self.people.clear()
                    stored = False
            last = ts
            if bot:
                who = 0
            elif (who := known.get(author)) is None:
                if len(known) >= KNOWN:
                    store()
                    known.clear()
                if stored and self.people.containsKey((author,)):
                    who = self.people.getValue((author,))[0]
                else:
                    people += 1
                    who = new[author] = people
                known[author] = who
            if text:
                if person is not None and who != person:
                    close()
                person = who
                pending.append(text)
            if len(out) >= GIVEN:
                yield _frame(out)
                out.clear()
        self._wait(left, end)
        store()
        if last is not None:
            # a message that would still go on with this section is late from here on
            if (last + self.gap) * 1000 <= passed:
                close()
            elif person is not None:
                wake.append((last + self.gap) * 1000)
            if pending:
                self.said.appendList([(x,) for x in pending])
            self.place.update((section, last, turn, person, people))
        least = self.runs.get()[1] if self.runs.exists() else None
        if least is not None:
            wake.append(least * 1000 + 1)
        if wake and min(wake) not in list(self.handle.listTimers()):
            self.handle.registerTimer(min(wake))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def live_turns(stream: DataFrame, bot: F.Column, delay: str = "10 minutes", gap: int = GAP_SECONDS) -> DataFrame:
    """(channel, section, turn_idx, person_id, text, late, id) of a stream of messages (channel, id, ts_secs, author_id, content).

    Turns are as `sessions.merged_turns` of `sessions.person_ids` of `sessions.sections` gives them, whatever
    batches the messages come in, if ids rise with times and nothing comes more than delay after the latest
    time seen. Rows that do are given as they came, with late true and their id. The state needs PROVIDER as the session's state store.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    rows = stream.withColumn("__at", F.timestamp_seconds("ts_secs")).withWatermark("__at", delay)
    # without the watermark's own column, so that Spark hands late rows on
    rows = rows.select(F.col("channel").cast("string").alias("channel"), "id", "ts_secs", F.col("author_id").cast("string").alias("author"), F.coalesce(bot, F.lit(False)).alias("bot"), T.sanitize_chat(F.coalesce("content", F.lit(""))).alias("text"))
    return rows.groupBy("channel").transformWithStateInPandas(_Turns(gap), OUT, "Append", "EventTime")
