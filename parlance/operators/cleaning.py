"""Cleaning rules over turns (section_idx, turn_idx, person_id, text, ...).

Person 0 is the bot. Rules are DataFrame -> DataFrame; their order matters and is that of `RULES`.
Section rules are windows over the section, caps rank rows within a text key; the two kinds of shuffle
are all that a whole cleaning needs, and rules in between run in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators.ordering import numbered
from parlance.session import checkpointed

ORDER = ["section_idx", "turn_idx"]
DEDUP_CAP, PREFIX_CAP, PREFIX_WORDS = 3, 10, 3


def _keep_sections(turns: DataFrame, condition: str) -> DataFrame:
    """Turns whose section's `turns`, `least` and `most` person meet the condition; one shuffle by section, shared by neighbours."""
    section = Window.partitionBy("section_idx")
    facts = {"turns": F.count(F.lit(1)), "most": F.max("person_id"), "least": F.min("person_id")}
    used = {f"__{k}": v.over(section) for k, v in facts.items() if k in condition}
    for k in facts:
        condition = condition.replace(k, f"__{k}")
    return turns.withColumns(used).where(condition).drop(*used)


def drop_monologues(turns: DataFrame) -> DataFrame:
    """Sections in which only the bot speaks."""
    return _keep_sections(turns, "most <> 0 or least <> 0")


def drop_single_speakers(turns: DataFrame) -> DataFrame:
    return _keep_sections(turns, "most <> least")


def drop_one_sided(turns: DataFrame) -> DataFrame:
    """Both of the above in one pass: a monologue has a single speaker."""
    return drop_single_speakers(turns)


def drop_short_sections(turns: DataFrame, least: int = 2) -> DataFrame:
    return _keep_sections(turns, f"turns >= {least}")


def drop_url_turns(turns: DataFrame) -> DataFrame:
    return turns.where(~T.is_url_dominant(F.col("text")))


def drop_wordless_turns(turns: DataFrame) -> DataFrame:
    return turns.where(T.has_alphanumeric(F.col("text")))


def drop_role_pings(turns: DataFrame) -> DataFrame:
    return turns.where(~T.is_role_ping_only(F.col("text")))


def turn_reason(text: Column) -> Column:
    """Which turn rule drops it: 4, 5 or 6, the first that applies; null if none."""
    return F.when(T.is_url_dominant(text), 4).when(~T.has_alphanumeric(text), 5).when(T.is_role_ping_only(text), 6)


def drop_turns(turns: DataFrame) -> DataFrame:
    return turns.where(turn_reason(F.col("text")).isNull())


#: Rows, counted, that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000


def cap_repeats(turns: DataFrame, most: int = DEDUP_CAP, key: Callable[[Column], Column] = T.dedup_key) -> DataFrame:
    """The first `most` turns of each text key, in corpus order; a turn is known by its place.

    Places move under 128 bits of their keys, and what goes is joined back, so texts stay where they are unless very many go.
    """
    short = turns.select(*ORDER, F.md5(F.coalesce(key(F.col("text")), F.lit(""))).alias("__key"))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(*ORDER))
    gone = checkpointed(short.withColumn("__nth", nth).where(F.col("__nth") > most).select(*ORDER))
    return turns.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ORDER, "left_anti")


def cap_prefixes(turns: DataFrame, most: int = PREFIX_CAP, n_words: int = PREFIX_WORDS) -> DataFrame:
    """Of bot turns with n words or more, the first `most` of each beginning; all other turns stay."""
    keyed = turns.withColumn("__key", F.when(F.col("person_id") == 0, T.prefix_key(F.col("text"), n_words)))
    exempt = keyed.where("__key is null").drop("__key")
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(*ORDER))
    capped = keyed.where("__key is not null").withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__key", "__nth")
    return exempt.unionByName(capped)


def _rewritten(turns: DataFrame, rewrite: Callable[[Column], tuple[Column, Column]], count: str | None) -> DataFrame:
    # text is one-spaced already, so a turn with nothing to rewrite comes out as it was
    new, n = rewrite(F.col("text"))
    return turns.withColumns({"text": new, **({count: n} if count else {})})


def rewrite_urls(turns: DataFrame, count: str | None = None) -> DataFrame:
    return _rewritten(turns, T.rewrite_urls, count)


def rewrite_mentions(turns: DataFrame, count: str | None = None) -> DataFrame:
    return _rewritten(turns, T.rewrite_mentions, count)


def rewrite_emoji(turns: DataFrame, count: str | None = None) -> DataFrame:
    return _rewritten(turns, T.rewrite_emoji, count)


def strip_markdown(turns: DataFrame, count: str | None = None) -> DataFrame:
    return _rewritten(turns, T.strip_markdown, count)


def strip_escapes(turns: DataFrame, count: str | None = None) -> DataFrame:
    return _rewritten(turns, T.strip_escapes, count)


def drop_empty_turns(turns: DataFrame) -> DataFrame:
    return turns.where(T.one_spaced_trim(F.col("text")) != "")


def shuffled(turns: DataFrame, seed: int = 0) -> DataFrame:
    """Sections in a seeded order that any cluster repeats: sorted by a hash of their index."""
    return turns.withColumn("shuffle_key", F.xxhash64(F.col("section_idx"), F.lit(seed))).orderBy("shuffle_key", *ORDER)


#: Name and rule, in the order in which they run.
RULES: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [
    ("one_sided", drop_one_sided),
    ("turns", drop_turns),
    ("repeats", cap_repeats),
    ("short", drop_short_sections),
    ("urls", rewrite_urls),
    ("mentions", rewrite_mentions),
    ("emoji", rewrite_emoji),
    ("markdown", strip_markdown),
    ("escapes", strip_escapes),
    ("empty", drop_empty_turns),
    ("short_again", drop_short_sections),
    ("prefixes", cap_prefixes),
    ("short_last", drop_short_sections),
]


def clean(turns: DataFrame, rules=RULES) -> DataFrame:
    for _, rule in rules:
        turns = rule(turns)
    return turns


def counters(turns: DataFrame) -> DataFrame:
    """(counter, n): sections and turns before and after cleaning, and what each rule dropped, touched or replaced.

    A section that is dropped as a monologue isn't counted as one with a single speaker, and a turn
    counts for the first rule that drops it. All rewrites are counted in one pass.
    """
    sizes = turns.groupBy("section_idx").agg(F.count(F.lit(1)).alias("n"), F.max("person_id").alias("most"), F.min("person_id").alias("least"))
    out = sizes.agg(F.count(F.lit(1)).alias("sections_before"), F.coalesce(F.sum("n"), F.lit(0)).alias("turns_before"), F.count_if(F.expr("most = 0 and least = 0")).alias("sec_monologue"), F.count_if(F.expr("most = least and most <> 0")).alias("sec_single_speaker"))
    spoken = drop_one_sided(turns)
    reason = spoken.withColumn("__r", turn_reason(F.col("text")))
    names = {4: "turn_url_dominant", 5: "turn_no_alphanum", 6: "turn_role_ping"}
    out = out.join(reason.agg(F.countDistinct("section_idx").alias("sections_spoken"), F.count_if(F.col("__r").isNull()).alias("turns_kept"), *[F.count_if(F.col("__r") == r).alias(c) for r, c in names.items()]))
    capped = checkpointed(cap_repeats(drop_turns(spoken)))
    out = out.join(capped.agg(F.count(F.lit(1)).alias("turns_capped")))
    rewrites = {"url_tokens": rewrite_urls, "mention_tokens": rewrite_mentions, "emoji_tokens": rewrite_emoji, "markdown_tokens": strip_markdown, "escape_chars": strip_escapes}
    rewritten = drop_short_sections(capped)
    for c, rule in rewrites.items():
        rewritten = rule(rewritten, c)
    rewritten = checkpointed(rewritten)  # from here on each step goes on from what the one before gave
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rewrites] + [F.count_if(F.col(c) > 0).alias(f"{c.split('_')[0]}_turns") for c in rewrites]
    out = out.join(rewritten.agg(*sums))
    full = checkpointed(drop_short_sections(drop_empty_turns(rewritten.drop(*rewrites))))
    out = out.join(full.agg(F.count(F.lit(1)).alias("turns_full")))
    short = checkpointed(cap_prefixes(full))
    out = out.join(short.agg(F.count(F.lit(1)).alias("turns_short")))
    left = drop_short_sections(short)
    out = out.join(left.agg(F.countDistinct("section_idx").alias("sections_after"), F.count(F.lit(1)).alias("turns_after")))
    out = out.withColumns({"turn_dedup_cap": F.expr("turns_kept - turns_capped"), "turn_prefix_cap": F.expr("turns_full - turns_short"), "sec_too_short": F.expr("sections_spoken - sections_after")})
    out = out.drop("sections_spoken", "turns_kept", "turns_capped", "turns_full", "turns_short")
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns]).unpivot([], out.columns, "counter", "n")


def clean_shuffled(turns: DataFrame, seed: int = 0) -> DataFrame:
    """Cleaned turns whose sections are renumbered from 0 in a seeded order, so that a tail of them is a fair sample."""
    kept = clean(turns)
    sections = kept.select("section_idx").distinct().withColumn("__hash", F.xxhash64("section_idx", F.lit(seed)))
    places = numbered(sections, ["__hash", "section_idx"], "__place").select("section_idx", F.col("__place").cast("long").alias("__place"))
    return kept.join(places, "section_idx").withColumn("section_idx", F.col("__place")).drop("__place")


def metrics(turns: DataFrame) -> DataFrame:
    """(step, sections, turns) before cleaning and after each rule, and what each rewrite replaced."""
    n, out = 0, []

    def counted(name, df, replaced=None):
        nonlocal n
        cols = [F.lit(n).alias("step"), F.lit(name).alias("rule"), F.countDistinct("section_idx").alias("sections"), F.count(F.lit(1)).alias("turns")]
        cols += [F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("replaced"), F.count_if(F.col("__c") > 0).alias("touched")] if replaced else [F.lit(0).cast("long").alias("replaced"), F.lit(0).cast("long").alias("touched")]
        out.append(df.agg(*cols))
        n += 1

    counted("input", turns)
    for name, rule in RULES:
        if name in ("urls", "mentions", "emoji", "markdown", "escapes"):
            counted(name, rule(turns, "__c"), True)
        else:
            counted(name, rule(turns))
        turns = checkpointed(rule(turns)) if name in ("repeats", "short", "empty", "prefixes") else rule(turns)
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result
