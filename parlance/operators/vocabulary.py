"""Vocabulary, token ids and training examples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.vectors import window_ids
from parlance.operators.ordering import numbered
from parlance.session import checkpointed
from parlance.sources import files
from parlance.sources.splits import lines, numbered_lines

CONTENT_CAP = 3000
TARGET_TOKENS = 20
PRELUDE_DROP = 0.3
CONTEXT = 32


def token_counts(turns: DataFrame) -> DataFrame:
    """(token, n) of content tokens; the specials that begin every vocabulary aren't counted."""
    tokens = turns.select(F.explode(T.tokenize(F.col("text"))).alias("token"))
    structural = F.col("token").isin(T.PAD, T.UNK, T.SEC) | F.col("token").rlike(r"^</?PERSON_\+?[0-9]+>\z")
    return tokens.where(~structural).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(turns: DataFrame, cap: int = CONTENT_CAP) -> DataFrame:
    """(id, token): padding, unknown, section, both tags of persons 0 to the largest, then content by count and token.

    cap 0 keeps all content, which is then numbered by ranges of counts and tokens, as many tokens share a count.
    """
    spark = turns.sparkSession
    fixed = spark.range(1).select(F.posexplode(F.array(F.lit(T.PAD), F.lit(T.UNK), F.lit(T.SEC))).alias("id", "token")).select(F.col("id").cast("long"), "token")
    people = turns.agg(F.coalesce(F.max("person_id"), F.lit(0)).cast("long").alias("most")).select(F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("p"))
    tags = people.select(F.posexplode(F.array(T.open_tag(F.col("p")), T.close_tag(F.col("p")))).alias("side", "token"), "p").select((3 + 2 * F.col("p") + F.col("side")).alias("id"), "token")
    counts = token_counts(turns)
    if cap:
        order = [F.desc("n"), F.asc("token")]
        ranked = counts.orderBy(*order).limit(cap).withColumn("nth", F.row_number().over(Window.orderBy(*order)) - 1)  # cap rows
    else:
        ranked = numbered(checkpointed(counts), [-F.col("n"), "token"])
    base = turns.agg((3 + 2 * (F.coalesce(F.max("person_id"), F.lit(0)).cast("long") + 1)).alias("base"))
    content = ranked.join(F.broadcast(base)).select((F.col("base") + F.col("nth")).alias("id"), "token")
    return fixed.unionByName(tags).unionByName(content)


#: Tokens, counted, of a vocabulary that every task may hold; beyond it they are looked up by a join.
BROADCAST_TOKENS = 200_000


def _known(vocab: DataFrame) -> DataFrame:
    """(token, id): the largest id of each token."""
    return vocab.where("token is not null").groupBy("token").agg(F.max("id").cast("bigint").alias("id"))


def token_ids(turns: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id): a row for each token of a turn that the vocabulary has; what a task holds is bounded by BROADCAST_TOKENS."""
    known = checkpointed(_known(vocab))
    known = F.broadcast(known) if known.count() <= BROADCAST_TOKENS else known
    return turns.select(*keys, F.explode(T.tokenize(F.col("text"))).alias("token")).join(known, "token").select(*keys, "id")


def encode(turns: DataFrame, vocab: DataFrame, unknown: int | None = 1, tagged: bool = False) -> DataFrame:
    """Turns with ids array<bigint>; a token that the vocabulary lacks is `unknown`. tagged adds the speaker's tags.

    A vocabulary of up to BROADCAST_TOKENS tokens is sent to all tasks, and each turn's tokens are
    looked up within its row. A larger one is joined token by token. Either way a turn
    is known by its place and stays one row.
    """
    tokens = T.tokenize(F.col("text"))
    tokens = T.wrap(F.col("person_id"), tokens) if tagged else tokens
    known = _known(vocab)
    held = known.limit(BROADCAST_TOKENS + 1).toArrow()
    if held.num_rows <= BROADCAST_TOKENS:
        return turns.withColumn("ids", _looked_up(held, unknown)(F.coalesce(tokens, F.array().cast("array<string>"))))
    each = turns.select("section_idx", "turn_idx", F.posexplode(tokens).alias("pos", "token")).join(known, "token", "left")
    id_ = F.coalesce("id", F.lit(unknown).cast("bigint"))
    ids = each.groupBy("section_idx", "turn_idx").agg(F.array_sort(F.collect_list(F.struct("pos", id_.alias("id")))).alias("p"))
    ids = ids.select("section_idx", "turn_idx", F.transform("p", lambda x: x["id"]).alias("ids"))
    return turns.join(ids, ["section_idx", "turn_idx"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def _looked_up(known: pa.Table, unknown: int | None):
    """A function of arrays of tokens that gives their ids, by known (token, id); whole Arrow batches are looked up at once."""
    words, numbers = (known.column(c).combine_chunks() for c in ("token", "id"))

    @F.arrow_udf("array<bigint>")
    def ids(lists: pa.Array) -> pa.Array:
        found = numbers.take(pc.index_in(lists.flatten(), value_set=words))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), found if unknown is None else found.fill_null(unknown))

    return ids


def forbidden(token: Column) -> Column:
    """What the bot never says: padding, unknown, section, placeholders, opening tags and others' closing tags."""
    closing = T.tag_person(token, closing=True)
    return token.isin(T.PAD, T.UNK, T.SEC, T.URL, T.MENTION, T.EMOJI) | T.tag_person(token).isNotNull() | F.coalesce(closing != 0, F.lit(False))


def examples(turns: DataFrame, target: int = TARGET_TOKENS) -> DataFrame:
    """(section_idx, turn_idx, prelude, query, target_person_id, target_tokens): each turn and its successor.

    The prelude holds all earlier turns of the section in their tags; it grows with the section by its nature.
    """
    order = Window.partitionBy("section_idx").orderBy("turn_idx")
    rows = turns.withColumn("tokens", T.tokenize(F.col("text"))).withColumn("query", T.wrap(F.col("person_id"), F.col("tokens")))
    prelude = F.flatten(F.collect_list("query").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.select("section_idx", "turn_idx", prelude.alias("prelude"), "query", F.lead("person_id").over(order).alias("target_person_id"), F.lead("tokens").over(order).alias("next"))
    return rows.where(F.size("next") > 0).select("section_idx", "turn_idx", "prelude", "query", "target_person_id", F.slice("next", 1, target).alias("target_tokens"))


def _last(array: str, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), F.lit(n))


def training_windows(turns: DataFrame, vocab: DataFrame, target: int = TARGET_TOKENS, tokens: int = CONTEXT) -> DataFrame:
    """(section_idx, turn_idx, step, window, label_id): the last 32 ids, padded on the left, before each target token.

    The closing tag is the last target; targets that the vocabulary lacks give no step but stay in the context.
    Of earlier turns only the last 32 ids are kept, so long sections cost no more than short ones a turn.
    """
    rows = encode(turns, vocab, None, tagged=True)
    order = Window.partitionBy("section_idx").orderBy("turn_idx")
    rows = rows.withColumn("tail", _last("ids", tokens))
    # a turn has two tags at least, so tokens / 2 turns always fill the context
    near = F.flatten(F.collect_list("tail").over(order.rowsBetween(-(tokens // 2), 0)))
    rows = rows.select("section_idx", "turn_idx", near.alias("near"), F.lead("ids").over(order).alias("next"))
    rows = rows.where(F.size("next") > 2)
    inner = F.size("next") - 2
    spoken = F.concat(F.slice("next", F.lit(2), F.least(inner, F.lit(target))), F.slice("next", -1, 1))
    rows = rows.select("section_idx", "turn_idx", F.concat("near", F.slice("next", 1, 1)).alias("before"), spoken.alias("spoken"))
    rows = rows.select("section_idx", "turn_idx", _last("before", tokens).alias("before"), "spoken", F.posexplode("spoken").alias("step", "label_id")).where("label_id is not null")
    seen = F.transform(F.concat("before", F.slice("spoken", F.lit(1), F.col("step"))), lambda i: F.coalesce(i, F.lit(1).cast("bigint")))
    rows = rows.select("section_idx", "turn_idx", "step", seen.alias("seen"), "label_id")
    return rows.select("section_idx", "turn_idx", "step", window_ids(F.col("seen"), tokens, 0).alias("window"), "label_id")


def _tail(rows: DataFrame, order: list[str], n: int, tail: int, most_train: int | None, most_val: int | None) -> DataFrame:
    nth = F.col("__nth")
    is_val = nth >= n - tail
    kept = numbered(rows, order, "__nth").withColumn("is_val", is_val)
    if most_train is not None:
        kept = kept.where(F.col("is_val") | (nth < most_train))
    if most_val is not None:
        kept = kept.where(~F.col("is_val") | (nth - (n - tail) < most_val))
    return kept.drop("__nth")


def validation_split(rows: DataFrame, fraction: float, order: list[str], n: int, most_train: int | None = None, most_val: int | None = None) -> DataFrame:
    """Adds is_val: the tail round(n * fraction), at least 1 and at most n - 1. n is the counted number of rows.

    After the split each part is cut to its first most_train or most_val rows, if these are given.
    """
    if n < 2:
        raise ValueError("a split needs two examples")
    return _tail(rows, order, n, min(max(int(n * fraction + 0.5), 1), n - 1), most_train, most_val)


def pretrain_split(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Adds is_val: the last tenth of n rows, rounded down; at least 1, at most n - 1."""
    return _tail(rows, order, n, min(max(n // 10, 1), max(n - 1, 0)), None, None)


def drop_preludes(rows: DataFrame, epoch: int, p: float = PRELUDE_DROP, seed: int = 0) -> DataFrame:
    """Training examples, of which a share p, another one each epoch, loses its prelude; a row's draw depends on its place alone."""
    draw = F.pmod(F.xxhash64("section_idx", "turn_idx", F.lit(epoch), F.lit(seed)), F.lit(1 << 32)) / (1 << 32)
    return rows.withColumn("prelude", F.when(draw < p, F.array().cast("array<string>")).otherwise(F.col("prelude")))


def prefix_histogram(turns: DataFrame, n_words: int = 3) -> DataFrame:
    """(prefix, turns) of the bot's turns with n words or more."""
    return turns.where("person_id = 0").select(T.prefix_key(F.col("text"), n_words).alias("prefix")).where("prefix is not null").groupBy("prefix").agg(F.count(F.lit(1)).alias("turns"))


def save(vocab: DataFrame, path: str) -> None:
    """A token a line; the files, in name order, hold them in order of the ids, and take the place of older ones once all are written."""
    rows = vocab.repartitionByRange("id").sortWithinPartitions("id").select("token")
    files.publish(vocab.sparkSession, path, lambda at: rows.write.text(at))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of what `save` wrote: ids are the lines' numbers."""
    files.restore(spark, path)
    return numbered_lines(lines(spark, path), "id").select(F.col("id").cast("long"), F.col("value").alias("token"))


def rebuild(turns: DataFrame, path: str, cap: int = CONTENT_CAP) -> int:
    """Builds the vocabulary of turns anew, saves it and returns its size."""
    save(vocabulary(turns, cap), path)
    return load(turns.sparkSession, path).count()
