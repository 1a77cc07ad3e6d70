"""Channels as streams: bounded history, and sections of a live message stream. `service` answers requests."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.functions import text as T

HISTORY = 20
GAP_SECONDS = 1800


def requests(stream: DataFrame, api_key: str | None = None) -> DataFrame:
    """(channel, seq, input) of JSON bodies (seq, body): the input trimmed and not empty, the channel `default` if none is named.

    With api_key, rows have a column api_key too, and those with another one or none are dropped.
    """
    if api_key is not None:
        stream = stream.where(F.coalesce(F.col("api_key"), F.lit("")) == api_key)
    rows = stream.select(F.coalesce(T.json_field(F.col("body"), "channel_id"), F.lit("default")).alias("channel"), "seq", T.one_spaced_trim(T.json_field(F.col("body"), "input")).alias("input"))
    return rows.where("input is not null and input <> ''")


def statuses(stream: DataFrame, api_key: str) -> DataFrame:
    """(seq, status) of requests (seq, api_key, body): 401 for another key, 400 without an input, else 200."""
    text = T.one_spaced_trim(T.json_field(F.col("body"), "input"))
    status = F.when(F.coalesce(F.col("api_key"), F.lit("")) != api_key, 401).when(F.coalesce(text, F.lit("")) == "", 400).otherwise(200)
    return stream.select("seq", status.alias("status"))


def chat(reply: Callable[[list[str], str], str], recall: Callable[[str], list[str]] = lambda text: []) -> Callable[[str, list[str]], str]:
    """An answer function for `history`: what recall finds for the input comes before the channel's own entries.

    reply gets the memory and the input. Where it fails, which is logged, the answer is None, and the channel stays as it was.
    """

    def answer(text: str, entries: list[str]) -> str | None:
        try:
            return reply([*recall(text), *entries], text)
        except Exception:  # a failed answer is a result of its own, which requests go on after
            logging.getLogger(__name__).exception("no reply")
            return None

    return answer


def history(stream: DataFrame, answer: Callable[[str, list[str]], str], most: int = HISTORY) -> DataFrame:
    """(channel, seq, reply, entries): the reply to each input, and the channel's last `most` entries after it.

    answer gets the input and the entries before it. Input and reply both enter, so 20 entries are 10
    exchanges; an answer of None is a failed one, after which the channel stays as it was. State is
    the list of entries alone.
    """

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState):
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for seq, text in zip(rows["seq"], rows["input"], strict=True):
            reply = answer(text, list(kept))
            if reply is not None:
                kept = [*kept, text, reply][-most:]
            out.append((key[0], seq, reply, list(kept)))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["channel", "seq", "reply", "entries"])

    return stream.groupBy("channel").applyInPandasWithState(update, "channel string, seq long, reply string, entries array<string>", "entries array<string>", "append", GroupStateTimeout.NoTimeout)


def sections(stream: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """(channel, id, section) of messages (channel, id, ts_secs): a gap of `gap` seconds or more starts a section.

    Messages of one micro-batch are taken in id order. One that comes in a later batch with a
    smaller id than the last is late: it joins the section that is open.
    """

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState):
        section, last_ts, last_id = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(frames)).sort_values("id", kind="stable")
        out = []
        for id_, ts in zip(rows["id"].tolist(), rows["ts_secs"].tolist(), strict=True):
            late = last_id is not None and id_ < last_id
            if not late:
                section += last_ts is not None and ts - last_ts >= gap
                last_ts, last_id = ts, id_
            out.append((key[0], id_, int(section)))
        state.update((int(section), last_ts, last_id))
        yield pd.DataFrame(out, columns=["channel", "id", "section"])

    return stream.groupBy("channel").applyInPandasWithState(update, "channel string, id long, section long", "section long, last_ts long, last_id long", "append", GroupStateTimeout.NoTimeout)
