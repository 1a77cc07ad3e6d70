"""Scans of chat logs, dialog lines, stories, conversation trees, seed pairs and persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import sessions
from parlance.operators.ordering import numbered
from parlance.session import checkpointed
from parlance.sources import splits


def chat_messages(lines: DataFrame) -> DataFrame:
    """Messages of tab-separated lines (channel, value): id, time, author, name, one ignored column, content.

    Lines of fewer than six columns and ids that are no numbers are skipped. A time that can't be
    read is taken from the id.
    """
    p = F.split("value", "\t", -1)
    rows = lines.where(F.size(p) >= 6).select("channel", p.alias("p"))
    id_, author = F.col("p")[0].try_cast("bigint"), F.col("p")[2].try_cast("bigint")
    content = T.unescape_tsv(F.array_join(F.slice("p", F.lit(6), F.size("p")), "\t"))
    rows = rows.select("channel", id_.alias("id"), F.coalesce(T.parse_seconds(F.col("p")[1]), T.snowflake_seconds(id_)).alias("ts_secs"), author.alias("author_id"), F.col("p")[3].alias("display_name"), content.alias("content"))
    return rows.where("id is not null and author_id is not null")


def read_chat(spark: SparkSession, root: str) -> DataFrame:
    """root/<bucket>/*.tsv; each file is a channel."""
    return chat_messages(spark.read.text(f"{root}/*/*.tsv").select(F.col("_metadata.file_path").alias("channel"), "value"))


def chat_turns(messages: DataFrame, bot_id: int, ranges: int | None = None) -> DataFrame:
    """Bot runs go, sections are cut at long gaps, speakers numbered, neighbours merged; sections of two turns or more stay.

    Channels are worked on in ranges of ids, so one of any length is many tasks.
    """
    bot = F.col("author_id") == bot_id
    spread = sessions.spread(messages, ranges)
    rows = sessions.person_ids(sessions.sections(sessions.drop_bot_runs(spread, bot)), bot)
    return sessions.keep_dialogs(sessions.merged_turns(rows))


def chat_corpus(turns: DataFrame) -> DataFrame:
    """Turns (section_idx, turn_idx, person_id, text) of `chat_turns`: sections numbered by channel, that is by path, and place."""
    turns = checkpointed(turns)
    places = numbered(turns.select("channel", "section").distinct(), ["channel", "section"], "section_idx")
    return turns.join(places, ["channel", "section"]).select("section_idx", F.col("turn_idx").cast("bigint"), F.col("person_id").cast("bigint"), "text")


def dialog_lines(lines: DataFrame, mark: str = "__eou__") -> DataFrame:
    """Turns of lines (section_idx, value): one dialog a line, speakers 1 and 0 in turn; two utterances at least."""
    parts = F.filter(F.transform(F.split("value", mark, -1), lambda x: T.sanitize(x)), lambda x: x != "")
    rows = lines.select("section_idx", parts.alias("p")).where(F.size("p") >= 2)
    rows = rows.select("section_idx", F.posexplode("p").alias("turn_idx", "text"))
    return rows.select("section_idx", F.col("turn_idx").cast("bigint"), F.when(F.col("turn_idx") % 2 == 0, 1).otherwise(0).alias("person_id"), "text")


def story_turns(stories: DataFrame, limit: int | None = None, least: int = 3, most: int = 18) -> DataFrame:
    """Turns of stories (section_idx, value): sentences of 3 to 18 words, all by the bot; two at least. limit counts kept stories."""
    kept = F.filter(F.transform(T.sentences(F.col("value")), lambda s: T.sanitize(s)), lambda s: F.size(T.words(s)).between(least, most))
    rows = stories.select("section_idx", kept.alias("s")).where(F.size("s") >= 2)
    if limit is not None:
        rows = rows.orderBy("section_idx").limit(limit)
    return rows.select("section_idx", F.posexplode("s").alias("turn_idx", "text")).select("section_idx", F.col("turn_idx").cast("bigint"), F.lit(0).alias("person_id"), "text")


def read_stories(spark: SparkSession, path: str, mark: str = "<|endoftext|>") -> DataFrame:
    """(section_idx, value) of files cut at mark; the index rises by path and place."""
    rows = splits.numbered_lines(splits.lines(spark, path, mark), "section_idx")
    return rows.where(T.one_spaced(F.col("value")) != "").select("section_idx", "value")


def tree_paths(nodes: DataFrame, most: int = 6) -> DataFrame:
    """(tree_id, depth, node_id, role, text): from each root the best reply, by rank (null last: 999) and place, up to `most` nodes.

    nodes (tree_id, node_id, parent_id, pos, rank, role, text); a root has no parent.
    """
    best = nodes.where("parent_id is not null").groupBy("tree_id", "parent_id").agg(F.min_by("node_id", F.struct(F.coalesce("rank", F.lit(999)), "pos")).alias("node_id"))
    path = nodes.where("parent_id is null").select("tree_id", F.lit(0).alias("depth"), "node_id")
    out = path
    for depth in range(1, most):
        path = path.select("tree_id", F.col("node_id").alias("parent_id")).join(best, ["tree_id", "parent_id"]).select("tree_id", F.lit(depth).alias("depth"), "node_id")
        out = out.unionByName(path)
    return out.join(nodes.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])


_LEVEL = "role string, text string, rank int"


def _tree_schema(depth: int) -> str:
    inner = f"struct<{_LEVEL.replace(' string', ': string').replace(' int', ': int')}>"
    for _ in range(depth - 1):
        inner = f"struct<{_LEVEL.replace(' string', ': string').replace(' int', ': int')}, replies: array<{inner}>>"
    return f"tree_state string, prompt struct<lang: string, {_LEVEL.replace(' string', ': string').replace(' int', ': int')}, replies: array<{inner}>>"


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(section_idx, value) of JSON lines, plain or .gz by suffix; the index rises by path and line."""
    rows = splits.numbered_lines(splits.lines(spark, path), "section_idx")
    return rows.where(F.trim("value") != "").select("section_idx", "value")


def _best(replies):
    """The reply of least rank; the first of equals."""
    keyed = F.transform(replies, lambda r, i: F.struct(F.coalesce(r["rank"], F.lit(999)).alias("rank"), i.alias("i"), r.alias("r")))
    return F.array_min(F.transform(keyed, lambda k: F.struct(k["rank"], k["i"])))["i"], keyed


def tree_turns(lines: DataFrame, lang: str = "en", limit: int | None = None, most: int = 6, cap: int = 400) -> DataFrame:
    """Turns of JSON lines (section_idx, value), one tree a line.

    Bad JSON and trees that aren't ready or in another language are skipped; limit counts trees
    before their turns are filtered. Of the best path each turn is cleaned, filtered and shortened
    by itself; two turns at least are left.
    """
    trees = lines.select("section_idx", F.from_json("value", _tree_schema(most)).alias("t")).where((F.col("t.tree_state") == "ready_for_export") & (F.col("t.prompt.lang") == lang))
    if limit is not None:
        trees = trees.orderBy("section_idx").limit(limit)
    node, levels = F.col("t.prompt"), []
    rows = trees
    for depth in range(most):
        rows = rows.withColumn(f"n{depth}", F.struct(node["role"].alias("role"), node["text"].alias("text")))
        levels.append(F.when(node.isNotNull(), F.struct(F.lit(depth).alias("depth"), F.col(f"n{depth}.role").alias("role"), F.col(f"n{depth}.text").alias("text"))))
        if depth < most - 1:
            place, _ = _best(node["replies"])
            rows = rows.withColumn(f"r{depth}", F.get(node["replies"], place))
            node = F.col(f"r{depth}")
    path = rows.select("section_idx", F.explode(F.array_compact(F.array(*levels))).alias("x"))
    path = path.select("section_idx", "x.depth", "x.role", T.sanitize_tree(F.coalesce("x.text", F.lit(""))).alias("text"))
    path = path.where(T.keep_tree_text(F.col("text"), F.col("role"))).withColumn("text", T.truncate_at_sentence(F.col("text"), cap))
    path = path.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("section_idx"))).where("__n >= 2")
    nth = F.row_number().over(Window.partitionBy("section_idx").orderBy("depth")) - 1
    return path.select("section_idx", nth.cast("bigint").alias("turn_idx"), F.when(F.col("role") == "assistant", 0).otherwise(1).alias("person_id"), "text")


def read_dialogs(spark: SparkSession, path: str) -> DataFrame:
    """(section_idx, value) of files with a dialog a line; the index rises by path and line."""
    return splits.numbered_lines(splits.lines(spark, path), "section_idx").select("section_idx", "value")


def seed_turns(pairs: DataFrame) -> DataFrame:
    """Turns of (section_idx, user, bot): two a pair, tags neutralised, spacing kept."""
    both = F.array(F.struct(F.lit(1).alias("person_id"), T.sanitize_tags(F.col("user")).alias("text")), F.struct(F.lit(0).alias("person_id"), T.sanitize_tags(F.col("bot")).alias("text")))
    return pairs.select("section_idx", F.posexplode(both).alias("turn_idx", "t")).select("section_idx", F.col("turn_idx").cast("bigint"), "t.person_id", "t.text")


def person_rows(lines: DataFrame) -> DataFrame:
    """Persons of lines (nth, value); an error where person_id isn't the line's number from 0."""
    p = F.split("value", "\t", 3)
    rows = lines.select("nth", F.get(p, 0).try_cast("bigint").alias("person_id"), F.get(p, 1).try_cast("bigint").alias("user_id"), F.get(p, 2).alias("display_name"))
    fine = F.coalesce(F.col("person_id") == F.col("nth"), F.lit(False))
    return rows.select(F.when(fine, F.col("person_id")).otherwise(F.raise_error(F.lit("person ids must count the rows")).cast("bigint")).alias("person_id"), "user_id", "display_name")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Turns of (conv_id, turn, role, text): the assistant is person 0, the user 1, anyone else 2."""
    person = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    return conversations.select(F.col("conv_id").alias("section_idx"), F.col("turn").alias("turn_idx"), person.alias("person_id"), T.one_spaced(F.col("text")).alias("text"))
