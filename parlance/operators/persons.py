"""Persons (person_id, user_id, display_name); person 0 is the bot, ids are gapless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators.ordering import numbered
from parlance.sources import files
from parlance.sources.ingest import person_rows
from parlance.sources.splits import lines, numbered_lines

SCHEMA = "person_id long, user_id long, display_name string"


def assign(persons: DataFrame, users: DataFrame) -> DataFrame:
    """persons and the users (user_id, display_name, first_seen) that it lacks, numbered on by first_seen.

    Known users keep their old name. Only new users are ranked, by ranges of first_seen, a number.
    """
    new = users.groupBy("user_id").agg(F.min(F.struct("first_seen", "display_name")).alias("f")).join(persons.select("user_id"), "user_id", "left_anti")
    next_id = persons.agg((F.coalesce(F.max("person_id"), F.lit(-1)) + 1).alias("next"))
    ranked = numbered(new.select("user_id", "f.first_seen", "f.display_name"), ["first_seen", "user_id"]).join(F.broadcast(next_id))
    added = ranked.select((F.col("next") + F.col("nth")).cast("long").alias("person_id"), "user_id", "display_name")
    return persons.select(F.col("person_id").cast("long").alias("person_id"), "user_id", "display_name").unionByName(added)


def ensure_bot(persons: DataFrame, user_id: int, name: str) -> DataFrame:
    """persons with the bot as row 0; an error if someone else is."""
    row = persons.where("person_id = 0").first()
    if row is None and persons.isEmpty():
        return persons.sparkSession.createDataFrame([(0, user_id, name)], "person_id long, user_id long, display_name string")
    if row is None or row["user_id"] != user_id:
        raise ValueError("person 0 isn't the bot")
    return persons


def lookup(persons: DataFrame, users: DataFrame) -> DataFrame:
    """users with person_id, null for those who aren't known."""
    return users.join(persons.select("user_id", "person_id"), "user_id", "left")


def tags(persons: DataFrame) -> DataFrame:
    return persons.select("person_id", T.open_tag(F.col("person_id")).alias("open"), T.close_tag(F.col("person_id")).alias("close"))


def save(persons: DataFrame, path: str) -> None:
    """Tab-separated lines whose files, in name order, hold them in order of person_id; line breaks in names become spaces."""
    name = F.regexp_replace(F.coalesce("display_name", F.lit("")), r"[\r\n]", " ")
    line = F.concat_ws("\t", F.col("person_id").cast("string"), F.col("user_id").cast("string"), name)
    rows = persons.repartitionByRange("person_id").sortWithinPartitions("person_id").select(line.alias("value"))
    files.publish(persons.sparkSession, path, lambda at: rows.write.text(at))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Persons of a file; none if there is no such file, an error where ids don't count the rows."""
    files.restore(spark, path)
    if not files.found(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return person_rows(numbered_lines(lines(spark, path), "nth").where("value <> ''"))
