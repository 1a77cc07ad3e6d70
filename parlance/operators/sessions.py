"""Sessions of message streams: messages (channel, id, ts_secs, author_id, content); every one has a channel and an id.

All that depends on the order of a channel's messages is worked out either in one window a channel
or, after `spread`, in ranges of its ids: each range by itself, then one summary row a range and
channel is scanned in order, and what it carries over (the last time, sections so far, the run of
messages that goes on) is joined back to the range. A channel of any length is then many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators.ordering import numbered, ranged
from parlance.session import checkpointed
from parlance.sources import files

GAP_SECONDS, BOT_RUN, WINDOW, STRIDE = 1800, 3, 20, 15
RANGE = "__range"


def spread(messages: DataFrame, ranges: int | None = None) -> DataFrame:
    """messages with a range of (channel, id) each, which the functions here then work in; their number follows the counted rows if not given."""
    return ranged(messages, ["channel", "id"], RANGE, ranges)


def _keys(rows: DataFrame, *keys: str) -> list[str]:
    return [*keys, RANGE] if RANGE in rows.columns else [*keys]


def _by_id(rows: DataFrame, *keys: str):
    return Window.partitionBy(*_keys(rows, *keys)).orderBy("id")


def _carried(rows: DataFrame, keys: list[str], summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """rows with the carry columns, which are windows over the summaries of the ranges.

    The summary is one row for keys and range; windows in carry order them by range. The rows are
    read twice, for their summary and for the join, so they are computed once and kept.
    """
    rows = checkpointed(rows)
    held = rows.groupBy(*keys, RANGE).agg(*[c.alias(n) for n, c in summary.items()])
    for name, column in carry.items():
        held = held.withColumn(name, column)
    names = [n for n in carry if not n.startswith("__own")]
    return rows.join(held.select(*keys, RANGE, *names), [*keys, RANGE])


def _before(*keys: str, turned: bool = False):
    """All ranges before (after, if turned) within keys."""
    return Window.partitionBy(*keys).orderBy(F.desc(RANGE) if turned else F.col(RANGE)).rowsBetween(Window.unboundedPreceding, -1)


def drop_bot_runs(messages: DataFrame, bot: Column, least: int = BOT_RUN) -> DataFrame:
    """Whole runs of at least `least` bot messages in a row go; shorter ones stay."""
    keys = _keys(messages, "channel")
    marked = messages.withColumn("__bot", F.coalesce(bot, F.lit(False))).withColumn("__nth", F.row_number().over(_by_id(messages, "channel")))
    marked = marked.withColumn("__run", F.col("__nth") - F.row_number().over(Window.partitionBy(*keys, "__bot").orderBy("id")))
    marked = marked.withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "__bot", "__run")))
    extra = ["__bot", "__nth", "__run", "__size"]
    if RANGE in messages.columns:
        other = F.when(~F.col("__bot"), F.col("__nth"))
        summary = {"n": F.count(F.lit(1)), "first": F.min(other), "last": F.max(other)}
        n, past = F.col("n"), F.lit(0)
        carry = {}
        # messages after the last one of another, in all ranges before; likewise to the other side
        for side, turned, rest in (("__in", False, n - F.col("last")), ("__out", True, F.col("first") - 1)):
            before = _before("channel", turned=turned)
            upto = before.rowsBetween(Window.unboundedPreceding, 0)
            carry[f"__own{side}"] = F.when(F.col("last").isNotNull(), F.sum("n").over(upto) - rest)
            carry[side] = F.coalesce(F.sum("n").over(before), past) - F.coalesce(F.last(f"__own{side}", ignorenulls=True).over(before), past)
        carry |= {"__lead": F.coalesce(F.col("first") - 1, n), "__tail": F.coalesce(F.col("last"), past)}
        marked = _carried(marked, ["channel"], summary, carry)
        joined = F.when(F.col("__nth") <= F.col("__lead"), F.col("__in")).otherwise(0) + F.when(F.col("__nth") > F.col("__tail"), F.col("__out")).otherwise(0)
        marked = marked.withColumn("__size", F.col("__size") + joined)
        extra += ["__in", "__out", "__lead", "__tail"]
    return marked.where(~(F.col("__bot") & (F.col("__size") >= least))).drop(*extra)


def sections(messages: DataFrame, gap: int = GAP_SECONDS, boundaries: DataFrame | None = None) -> DataFrame:
    """Adds section, numbered from 0 in a channel: a gap of `gap` seconds or more, in id order, starts one.

    boundaries (channel, id) names further messages that start a section.
    """
    by_id = _by_id(messages, "channel")
    if boundaries is not None:
        messages = messages.join(boundaries.select("channel", "id").distinct().withColumn("__start", F.lit(True)), ["channel", "id"], "left")
    else:
        messages = messages.withColumn("__start", F.lit(False))
    start = F.coalesce(F.col("__start"), F.lit(False))
    flagged = messages.withColumn("__first", F.row_number().over(by_id) == 1)
    flagged = flagged.withColumn("__new", (~F.col("__first") & (F.coalesce(F.col("ts_secs") - F.lag("ts_secs").over(by_id) >= gap, F.lit(False)) | start)).cast("int"))
    section = F.sum("__new").over(by_id)
    if RANGE in messages.columns:
        summary = {"first": F.min_by("ts_secs", "id"), "last": F.max_by("ts_secs", "id"), "start": F.min_by(start, "id"), "inner": F.sum("__new")}
        order = Window.partitionBy("channel").orderBy(RANGE)
        opens = (F.row_number().over(order) > 1) & (F.coalesce(F.col("first") - F.lag("last").over(order) >= gap, F.lit(False)) | F.col("start"))
        carry = {"__own": opens.cast("int"), "__base": F.coalesce(F.sum(F.col("inner") + F.col("__own")).over(_before("channel")), F.lit(0)) + F.col("__own")}
        flagged = _carried(flagged, ["channel"], summary, carry)
        section = section + F.col("__base")
    return flagged.withColumn("section", section).drop("__new", "__start", "__first", "__base")


def person_ids(messages: DataFrame, bot: Column) -> DataFrame:
    """Adds person_id within the section: 0 for the bot, others from 1 by first message."""
    if RANGE in messages.columns:
        marked = checkpointed(messages.withColumn("__bot", F.coalesce(bot, F.lit(False))))  # read three times
        first = checkpointed(marked.where("not __bot").groupBy("channel", "section", "author_id").agg(F.min("id").alias("first")))
        placed = numbered(first, ["channel", "section", "first"], "__nth")
        base = placed.groupBy("channel", "section").agg(F.min("__nth").alias("__base"))
        people = placed.join(base, ["channel", "section"]).select(F.col("channel").alias("__c"), F.col("section").alias("__s"), F.col("author_id").alias("__a"), (F.col("__nth") - F.col("__base") + 1).alias("__person"))
        on = [F.col("channel") == F.col("__c"), F.col("section") == F.col("__s"), F.col("author_id").eqNullSafe(F.col("__a"))]
        # the bot's rows take no part in the join, however many they are
        known = marked.where("not __bot").join(people, on).withColumn("person_id", F.col("__person").cast("int"))
        rest = marked.where("__bot").withColumn("person_id", F.lit(0))
        return known.select(*messages.columns, "person_id").unionByName(rest.select(*messages.columns, "person_id"))
    section = Window.partitionBy("channel", "section")
    first = F.min("id").over(Window.partitionBy("channel", "section", "author_id"))
    ranked = messages.withColumn("__bot", F.coalesce(bot, F.lit(False))).withColumn("__first", F.when(~F.col("__bot"), first))
    place = F.dense_rank().over(section.orderBy(F.col("__first").asc_nulls_first()))
    has_bot = F.max(F.col("__bot").cast("int")).over(section)
    return ranked.withColumn("person_id", F.when(F.col("__bot"), 0).otherwise(place - has_bot)).drop("__bot", "__first")


def merged_turns(messages: DataFrame, clean: bool = True) -> DataFrame:
    """Turns (channel, section, turn_idx, person_id, text): empty messages go, then neighbours of one speaker join.

    A section's pieces of one turn are joined in id order; a turn is bounded by its section.
    """
    text = T.sanitize_chat(F.col("content")) if clean else F.col("content")
    rows = messages.withColumn("__text", text).where("__text <> ''")
    order = _by_id(rows, "channel", "section")
    rows = rows.withColumn("__new", F.coalesce(F.col("person_id") != F.lag("person_id").over(order), F.lit(False)).cast("int"))
    turn = F.sum("__new").over(order)
    if RANGE in messages.columns:
        keys = ["channel", "section"]
        summary = {"first": F.min_by("person_id", "id"), "last": F.max_by("person_id", "id"), "inner": F.sum("__new")}
        opens = F.coalesce(F.col("first") != F.lag("last").over(Window.partitionBy(*keys).orderBy(RANGE)), F.lit(False))
        carry = {"__own": opens.cast("int"), "__base": F.coalesce(F.sum(F.col("inner") + F.col("__own")).over(_before(*keys)), F.lit(0)) + F.col("__own")}
        rows = _carried(rows, keys, summary, carry)
        turn = turn + F.col("__base")
    rows = rows.withColumn("turn_idx", turn)
    pieces = F.array_sort(F.collect_list(F.struct("id", "__text")))
    turns = rows.groupBy("channel", "section", "turn_idx", "person_id").agg(pieces.alias("__p"))
    return turns.select("channel", "section", "turn_idx", "person_id", F.array_join(F.transform("__p", lambda x: x["__text"]), " ").alias("text"))


def keep_dialogs(turns: DataFrame, least: int = 2) -> DataFrame:
    sizes = turns.groupBy("channel", "section").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return turns.join(sizes.select("channel", "section"), ["channel", "section"], "left_semi")


def sliding_windows(messages: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(channel, window, position, id): windows of `size` messages every `stride`, by explode of each row's windows."""
    rows = messages.withColumn("__i", F.row_number().over(_by_id(messages, "channel")) - 1)
    if RANGE in messages.columns:
        rows = _carried(rows, ["channel"], {"n": F.count(F.lit(1))}, {"__base": F.coalesce(F.sum("n").over(_before("channel")), F.lit(0))}).withColumn("__i", F.col("__i") + F.col("__base"))
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - size + 1) / stride)).cast("int")
    rows = rows.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("__i") / stride).cast("int"))))
    return rows.select("channel", "window", (F.col("__i") - F.col("window") * stride).cast("int").alias("position"), "id")


def window_prompt(messages: DataFrame) -> DataFrame:
    """A numbered transcript of each window, for an outside model that names boundaries."""
    rows = sliding_windows(messages).join(messages, ["channel", "id"])
    line = F.concat(F.col("position").cast("string"), F.lit(". "), F.col("author_id").cast("string"), F.lit(": "), T.sanitize_prompt(F.col("content")))
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return rows.groupBy("channel", "window").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))


def window_boundaries(messages: DataFrame, answers: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """(channel, id) of messages that start a section by answers (channel, window, answer), one for each window.

    An answer is a text with an array of positions. Position 0 starts the window, not a section, and
    counts for nothing; nor do positions beyond the window. Windows that overlap give a message once.
    """
    at = answers.select("channel", "window", F.explode(F.array_distinct(T.index_array(F.col("answer")))).alias("position")).where("position >= 1")
    return sliding_windows(messages, size, stride).join(at, ["channel", "window", "position"]).select("channel", "id").distinct()


def cache_keys(messages: DataFrame) -> DataFrame:
    """(channel, key): the first and the last id of a channel; what is kept for a channel holds as long as its key does."""
    return messages.groupBy("channel").agg(F.concat_ws(":", F.min("id"), F.max("id")).alias("key"))


def keep_boundaries(messages: DataFrame, boundaries: DataFrame, path: str) -> None:
    """Writes (key, ids) of all channels of messages, also those without boundaries, to the cache at path, a folder a channel.

    A channel's entry takes the place of its older one; those of other channels stay.
    """
    ids = boundaries.groupBy("channel").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    kept = cache_keys(messages).join(ids, "channel", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    kept.repartition("channel").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("channel").parquet(path)


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """The cache (channel, key, ids) at path; empty if there is none."""
    schema = "key string, ids array<bigint>, channel string"
    return spark.read.schema(schema).parquet(path) if files.found(spark, path) else spark.createDataFrame([], schema)


def kept_boundaries(messages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boundaries (channel, id) of channels whose key the cache (channel, key, ids) has, and the channels (channel) that it lacks."""
    keys = cache_keys(messages)
    valid = cache.join(keys, ["channel", "key"], "left_semi")
    return valid.select("channel", F.explode("ids").alias("id")).distinct(), keys.join(valid, "channel", "left_anti").select("channel")


def boundaries_with(messages: DataFrame, path: str, find) -> DataFrame:
    """Boundaries of all channels: those kept at path while a channel's key holds, and what find(messages) gives for the others, which is kept."""
    kept, lacking = kept_boundaries(messages, read_boundaries(messages.sparkSession, path))
    kept, todo = checkpointed(kept), checkpointed(messages.join(lacking, "channel", "left_semi"))
    if todo.isEmpty():
        return kept
    found = checkpointed(find(todo).select("channel", "id").distinct())
    keep_boundaries(todo, found, path)
    return kept.unionByName(found)


def totals(turns: DataFrame) -> DataFrame:
    return turns.agg(F.countDistinct("channel", "section").alias("sections"), F.count(F.lit(1)).alias("turns"), (F.max("person_id") + 1).alias("persons"))
