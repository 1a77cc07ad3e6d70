"""Registered queries and the SQL that gives the same rows in another engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions import vectors as V
from parlance.operators import cleaning, persons, retrieval, sessions, vocabulary
from parlance.session import checkpointed, shared_folder, table
from parlance.sources import corpus, ingest, splits
from parlance.streaming import service
from parlance.streaming import turns as live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# ---- inputs -------------------------------------------------------------------------------------

#: Turns with all that the cleaning rules look for; one expression for both engines.
NOISE = """CASE (section_idx * 7 + turn_idx) % 12
 WHEN 0 THEN 'https://e.org/x lol' WHEN 1 THEN text || ' https://e.org/y' WHEN 2 THEN '@everyone @123'
 WHEN 3 THEN '!!! ???' WHEN 4 THEN 'Same Spam Line' WHEN 5 THEN text || ' (@123) :kek:'
 WHEN 6 THEN '- **bold** ' || text || ' -- end'
 WHEN 7 THEN text || chr(92) || 'nline' || chr(92) || chr(92) || 'x' || chr(92)
 WHEN 8 THEN '42. ' || text WHEN 9 THEN 'Here are some ' || text WHEN 10 THEN '__a__ __URL__ ' || text ELSE text END"""
PERSON = "CASE section_idx % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE person_id END"


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.conversation_turns(table(spark, sf_dir, "conversations"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_of(spark, sf_dir).select("section_idx", "turn_idx", F.expr(PERSON).alias("person_id"), F.expr(NOISE).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def document_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("section_idx"), F.lit(0).cast("long").alias("turn_idx"), F.lit(0).alias("person_id"), T.one_spaced(F.col("text")).alias("text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chat messages of ten channels; an event's type is its author, and `error` is the bot."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 10).alias("channel"), F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("ts_secs"), F.col("event_type").alias("author_id"), F.concat_ws(" ", "event_type", (F.col("event_id") % 7).cast("string")).alias("content"))


def _bot():
    return F.col("author_id") == "error"


# ---- SQL pieces ---------------------------------------------------------------------------------

URL = r"^[(\[<]*(https?://|www\.|tenor\.com/|discord\.gg/|discord\.com/|cdn\.discordapp\.com/|youtube\.com/|youtu\.be/)"
MENTION = r"^\((@&?[0-9]+|#[0-9]+|t:[0-9]+:R|id:browse)\)$"
EMOJI = r"^:[A-Za-z0-9_]{2,32}:$"
PING = r"^@(everyone|here|[0-9]+)$"


def w(text: str = "text") -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


def tidy(text: str) -> str:
    return f"array_to_string({w(text)}, ' ')"


def tokens(text: str = "text") -> str:
    special = "w IN ('<PAD>','<UNK>','<SEC>','__URL__','__MENTION__','__EMOJI__','</BOT>','<USER>','</USER>','<BOT>') OR regexp_matches(w, '^</?PERSON_\\+?[0-9]+>$')"
    return rf"flatten(list_transform({w(text)}, lambda w: CASE WHEN {special} THEN [w] ELSE regexp_extract_all(lower(w), '[\p{{L}}\p{{N}}'']+|[^\p{{L}}\p{{N}}''\s]') END))"


def replaced(pattern: str, new: str, text: str = "text") -> str:
    return f"array_to_string(list_transform({w(text)}, lambda w: CASE WHEN regexp_matches(w, '{pattern}') THEN '{new}' ELSE w END), ' ')"


def hits(pattern: str, text: str = "text") -> str:
    return f"len(list_filter({w(text)}, lambda w: regexp_matches(w, '{pattern}')))"


URL_ONLY = f"({hits(URL)} > 0 AND length(array_to_string(list_filter({w()}, lambda w: NOT regexp_matches(w, '{URL}')), '')) < 8)"
WORDLESS = r"(NOT regexp_matches(text, '[\p{L}\p{N}]'))"
PING_ONLY = f"(len({w()}) > 0 AND {hits(PING)} = len({w()}))"


def markdown(text: str) -> str:
    s = rf"regexp_replace({text}, '\*{{2,}}', ' ', 'g')"
    placeholder = "__(URL|MENTION|EMOJI)__$"
    word = f"CASE WHEN regexp_matches(w, '(^|[^_]){placeholder}') THEN regexp_replace(regexp_replace(w, '{placeholder}', ''), '_{{2,}}', ' ', 'g') || regexp_extract(w, '{placeholder}') ELSE regexp_replace(w, '_{{2,}}', ' ', 'g') END"
    s = rf"array_to_string(list_transform(regexp_split_to_array({s}, '\s'), lambda w: {word}), ' ')"
    s = f"regexp_replace({s}, '-{{2,}}', '-', 'g')"
    s = rf"array_to_string(list_filter(regexp_split_to_array({s}, '\s+'), lambda w: w <> '*' AND w <> ''), ' ')"
    s = f"regexp_replace({s}, '^(:- |- |: )', '')"
    s = rf"regexp_replace({s}, '^[0-9]+\. ', '')"
    return tidy(s)


def escapes(text: str) -> str:
    parts = rf"regexp_extract_all({text}, '\\.|\\|[^\\]+', 0, 's')"
    part = r"CASE WHEN p[1] <> '\' THEN p WHEN p IN ('\n', '\r', '\t') THEN ' ' WHEN p IN ('\\', '\') THEN '' ELSE p[2] END"
    return tidy(f"array_to_string(list_transform({parts}, lambda p: {part}), '')")


TURNS = f"turns AS (SELECT conv_id AS section_idx, turn AS turn_idx, CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS person_id, {tidy('text')} AS text FROM conversations)"
NOISY = f"{TURNS}, noisy AS (SELECT section_idx, turn_idx, {PERSON} AS person_id, {NOISE} AS text FROM turns)"
DOCS = f"docs AS (SELECT doc_id AS section_idx, 0 AS turn_idx, 0 AS person_id, {tidy('text')} AS text FROM documents)"


def kept_sections(source: str, having: str) -> str:
    return f"SELECT * FROM {source} WHERE section_idx IN (SELECT section_idx FROM {source} GROUP BY section_idx HAVING {having})"


def capped(source: str, key: str, most: int, where: str = "true") -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY ({where}), CASE WHEN {where} THEN {key} END ORDER BY section_idx, turn_idx) AS nth FROM {source}"
    return f"SELECT section_idx, turn_idx, person_id, text FROM ({ranked}) WHERE NOT ({where}) OR nth <= {most}"


def rewritten(source: str, text: str) -> str:
    return f"SELECT section_idx, turn_idx, person_id, {text} AS text FROM {source}"


DEDUP_KEY = r"lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))"
PREFIX = f"person_id = 0 AND len({w()}) >= 3"
STEPS = [
    ("one_sided", kept_sections("noisy", "min(person_id) <> max(person_id)")),
    ("turns", f"SELECT * FROM one_sided WHERE NOT {URL_ONLY} AND NOT {WORDLESS} AND NOT {PING_ONLY}"),
    ("repeats", capped("turns_", DEDUP_KEY, 3)),
    ("short", kept_sections("repeats", "count(*) >= 2")),
    ("urls", rewritten("short", replaced(URL, "__URL__"))),
    ("mentions", rewritten("urls", replaced(MENTION, "__MENTION__"))),
    ("emoji", rewritten("mentions", replaced(EMOJI, "__EMOJI__"))),
    ("markdown", rewritten("emoji", markdown("text"))),
    ("escapes", rewritten("markdown", escapes("text"))),
    ("empty", "SELECT * FROM escapes WHERE text <> ''"),
    ("short_again", kept_sections("empty_", "count(*) >= 2")),
    ("prefixes", capped("short_again", f"lower(array_to_string(({w()})[1:3], ' '))", 10, PREFIX)),
    ("short_last", kept_sections("prefixes", "count(*) >= 2")),
]
#: Names that are words of the language get an underscore.
CLEANED = NOISY + ", " + ", ".join(f"{'turns_' if n == 'turns' else 'empty_' if n == 'empty' else n} AS MATERIALIZED ({s})" for n, s in STEPS)


def turn_rows(source: str) -> str:
    return f"SELECT section_idx, turn_idx, CAST(person_id AS INTEGER) AS person_id, text FROM {source}"


def _turn_cols(df: DataFrame) -> DataFrame:
    return df.select("section_idx", "turn_idx", F.col("person_id").cast("int").alias("person_id"), "text")


# ---- vocabulary ---------------------------------------------------------------------------------

@query("vocab_top_tokens", f"WITH {DOCS}, k AS ({capped('docs', DEDUP_KEY, 3)}) SELECT token, count(*) AS n FROM (SELECT unnest({tokens()}) AS token FROM k) GROUP BY token ORDER BY n DESC, token LIMIT 20")
def vocab_top_tokens(spark, sf_dir):
    return vocabulary.token_counts(cleaning.cap_repeats(document_turns(spark, sf_dir))).orderBy(F.desc("n"), "token").limit(20)


VOCAB = f"""counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({tokens()}) AS token FROM turns) WHERE token NOT IN ('<PAD>','<UNK>','<SEC>') AND NOT regexp_matches(token, '^</?PERSON_\\+?[0-9]+>$') GROUP BY token),
 ranked AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS nth FROM counts QUALIFY nth <= 3000),
 top AS (SELECT max(person_id) AS m FROM turns),
 vocab AS (SELECT id, token FROM (VALUES (0, '<PAD>'), (1, '<UNK>'), (2, '<SEC>')) t(id, token)
 UNION ALL SELECT 3 + 2 * p, '<PERSON_' || p || '>' FROM (SELECT unnest(range(0, m + 1)) AS p FROM top)
 UNION ALL SELECT 4 + 2 * p, '</PERSON_' || p || '>' FROM (SELECT unnest(range(0, m + 1)) AS p FROM top)
 UNION ALL SELECT 3 + 2 * (m + 1) + nth - 1, token FROM ranked, top)"""


@query("vocab_full", f"WITH {TURNS}, {VOCAB} SELECT CAST(id AS BIGINT) AS id, token FROM vocab")
def vocab_full(spark, sf_dir):
    return vocabulary.vocabulary(turns_of(spark, sf_dir))


@query("vocab_whole", f"WITH {TURNS}, {VOCAB.replace(' QUALIFY nth <= 3000', '')} SELECT CAST(id AS BIGINT) AS id, token FROM vocab")
def vocab_whole(spark, sf_dir):
    return vocabulary.vocabulary(turns_of(spark, sf_dir), 0)


@query("corpus_scan", f"WITH {TURNS} SELECT CAST(dense_rank() OVER (ORDER BY section_idx) - 1 AS BIGINT) AS section_idx, row_number() OVER (PARTITION BY section_idx ORDER BY turn_idx) - 1 AS turn_idx, CAST(person_id AS BIGINT) AS person_id, text FROM turns")
def corpus_scan(spark, sf_dir):
    """Turns of a corpus written to files of the shared folder and read again, split by split."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    corpus.write(turns_of(spark, sf_dir), path)
    return corpus.read(spark, path)


@query("line_numbers", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, doc_id, md5(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''), ' ')) AS text_md5 FROM documents")
def line_numbers(spark, sf_dir):
    """Lines of files in the shared folder, numbered by path and place; the files' names rise with doc_id."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), T.one_spaced(F.coalesce("text", F.lit(""))))
    documents(spark, sf_dir).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    cut = F.instr("value", " ")
    rows = splits.numbered_lines(splits.lines(spark, path))
    return rows.select("line", F.substring_index("value", " ", 1).cast("long").alias("doc_id"), F.md5(F.when(cut > 0, F.substr("value", cut + 1)).otherwise("")).alias("text_md5"))


@query("tokenize_counts", f"WITH {NOISY} SELECT section_idx, turn_idx, CAST(len({tokens()}) AS BIGINT) AS n_tokens, array_to_string({tokens()}, ' ') AS tokens FROM noisy")
def tokenize_counts(spark, sf_dir):
    t = T.tokenize(F.col("text"))
    return noisy(spark, sf_dir).select("section_idx", "turn_idx", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


IDS = f"ids AS (SELECT section_idx, turn_idx, string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS n, count(*) FILTER (v.id IS NULL) AS unknown FROM (SELECT section_idx, turn_idx, unnest({tokens()}) AS token, generate_subscripts({tokens()}, 1) AS pos FROM turns) t LEFT JOIN vocab v USING (token) GROUP BY section_idx, turn_idx)"


@query("encode_ids", f"WITH {TURNS}, {VOCAB}, {IDS} SELECT section_idx, turn_idx, coalesce(ids, '') AS ids FROM turns LEFT JOIN ids USING (section_idx, turn_idx)")
def encode_ids(spark, sf_dir):
    turns = turns_of(spark, sf_dir)
    return vocabulary.encode(turns, vocabulary.vocabulary(turns)).select("section_idx", "turn_idx", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("unk_rate", f"WITH {TURNS}, {VOCAB}, {IDS} SELECT CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(unknown) AS BIGINT) AS n_unknown FROM ids")
def unk_rate(spark, sf_dir):
    turns = turns_of(spark, sf_dir)
    ids = vocabulary.encode(turns, vocabulary.vocabulary(turns))
    return ids.agg(F.sum(F.size("ids")).cast("long").alias("n_tokens"), F.sum(F.size(F.filter("ids", lambda i: i == 1))).cast("long").alias("n_unknown"))


@query("forbidden_ids", f"WITH {TURNS}, {VOCAB} SELECT CAST(id AS BIGINT) AS id, token FROM vocab WHERE token IN ('<PAD>','<UNK>','<SEC>','__URL__','__MENTION__','__EMOJI__') OR regexp_matches(token, '^<PERSON_[0-9]+>$') OR regexp_matches(token, '^</PERSON_[1-9][0-9]*>$')")
def forbidden_ids(spark, sf_dir):
    return vocabulary.vocabulary(turns_of(spark, sf_dir)).where(vocabulary.forbidden(F.col("token")))


# ---- cleaning -----------------------------------------------------------------------------------

@query("dedup_cap3", f"WITH {DOCS}, k AS ({capped('docs', DEDUP_KEY, 3)}) SELECT section_idx AS doc_id FROM k")
def dedup_cap3(spark, sf_dir):
    return cleaning.cap_repeats(document_turns(spark, sf_dir)).select(F.col("section_idx").alias("doc_id"))


@query("prefix_cap10", f"WITH {NOISY}, k AS ({capped('noisy', f'''lower(array_to_string(({w()})[1:3], ' '))''', 10, PREFIX)}) SELECT section_idx, turn_idx FROM k")
def prefix_cap10(spark, sf_dir):
    return cleaning.cap_prefixes(noisy(spark, sf_dir)).select("section_idx", "turn_idx")


@query("rule_turns", f"WITH {NOISY} SELECT section_idx, turn_idx, CASE WHEN {URL_ONLY} THEN 4 WHEN {WORDLESS} THEN 5 WHEN {PING_ONLY} THEN 6 END AS reason FROM noisy")
def rule_turns(spark, sf_dir):
    return noisy(spark, sf_dir).select("section_idx", "turn_idx", cleaning.turn_reason(F.col("text")).alias("reason"))


for _name, _sql, _rule in [
    ("rule_url_dominant", f"NOT {URL_ONLY}", cleaning.drop_url_turns),
    ("rule_no_alnum", f"NOT {WORDLESS}", cleaning.drop_wordless_turns),
    ("rule_role_ping", f"NOT {PING_ONLY}", cleaning.drop_role_pings),
]:
    query(_name, f"WITH {NOISY} SELECT section_idx, turn_idx, text FROM noisy WHERE {_sql}")(lambda spark, sf_dir, rule=_rule: rule(noisy(spark, sf_dir)).select("section_idx", "turn_idx", "text"))

for _name, _sql, _rule in [
    ("rule_monologue", "max(person_id) <> 0 OR min(person_id) <> 0", cleaning.drop_monologues),
    ("rule_single_speaker", "min(person_id) <> max(person_id)", cleaning.drop_single_speakers),
    ("rule_short_section", "count(*) >= 4", lambda t: cleaning.drop_short_sections(t, 4)),
]:
    query(_name, f"WITH {NOISY}, k AS ({kept_sections('noisy', _sql)}) SELECT section_idx, turn_idx FROM k")(lambda spark, sf_dir, rule=_rule: rule(noisy(spark, sf_dir)).select("section_idx", "turn_idx"))

for _name, _pattern, _new, _f in [("rewrite_urls", URL, "__URL__", T.rewrite_urls), ("rewrite_mentions", MENTION, "__MENTION__", T.rewrite_mentions), ("rewrite_emoji", EMOJI, "__EMOJI__", T.rewrite_emoji)]:
    def _run(spark, sf_dir, f=_f):
        text, n = f(F.col("text"))
        return noisy(spark, sf_dir).select("section_idx", "turn_idx", text.alias("text"), n.cast("long").alias("n"))

    query(_name, f"WITH {NOISY} SELECT section_idx, turn_idx, {replaced(_pattern, _new)} AS text, CAST({hits(_pattern)} AS BIGINT) AS n FROM noisy")(_run)


@query("page_urls", f"SELECT page_id, CAST({hits(URL, 'html')} AS BIGINT) AS n_urls, {replaced(URL, '__URL__', 'html')} AS html FROM pages")
def page_urls(spark, sf_dir):
    text, n = T.rewrite_urls(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", n.cast("long").alias("n_urls"), text.alias("html"))


@query("strip_markdown", f"WITH {DOCS}, {NOISY} SELECT section_idx, turn_idx, {markdown('text')} AS text FROM (SELECT * FROM noisy UNION ALL SELECT * FROM docs)")
def strip_markdown(spark, sf_dir):
    both = _turn_cols(noisy(spark, sf_dir)).unionByName(_turn_cols(document_turns(spark, sf_dir)))
    return both.select("section_idx", "turn_idx", T.strip_markdown(F.col("text"))[0].alias("text"))


@query("strip_escapes", f"WITH {NOISY} SELECT section_idx, turn_idx, {escapes('text')} AS text FROM noisy")
def strip_escapes(spark, sf_dir):
    return noisy(spark, sf_dir).select("section_idx", "turn_idx", T.strip_escapes(F.col("text"))[0].alias("text"))


@query("clean_pipeline", f"WITH {CLEANED} {turn_rows('short_last')}")
def clean_pipeline(spark, sf_dir):
    return _turn_cols(cleaning.clean(noisy(spark, sf_dir)))


_COUNTS = " UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS rule, count(DISTINCT section_idx) AS sections, count(*) AS turns FROM {'turns_' if n == 'turns' else 'empty_' if n == 'empty' else 'noisy' if n == 'input' else n}" for i, (n, _) in enumerate([("input", ""), *STEPS]))


@query("clean_metrics", f"WITH {CLEANED} {_COUNTS}")
def clean_metrics(spark, sf_dir):
    return cleaning.metrics(noisy(spark, sf_dir)).select("step", "rule", "sections", "turns")


# ---- sessions -----------------------------------------------------------------------------------

MSGS = "m AS (SELECT user_id % 10 AS channel, event_id AS id, epoch_us(ts) // 1000000 AS ts_secs, event_type AS author_id, event_type || ' ' || CAST(event_id % 7 AS VARCHAR) AS content FROM events)"


def sectioned(source: str) -> str:
    return f"SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY id) AS section FROM (SELECT *, CASE WHEN ts_secs - lag(ts_secs) OVER (PARTITION BY channel ORDER BY id) >= 1800 THEN 1 ELSE 0 END AS new FROM {source})"


RUNS = "f AS (SELECT channel, id, ts_secs, author_id, content FROM (SELECT *, count(*) OVER (PARTITION BY channel, bot, run) AS size FROM (SELECT *, author_id = 'error' AS bot, row_number() OVER (PARTITION BY channel ORDER BY id) - row_number() OVER (PARTITION BY channel, author_id = 'error' ORDER BY id) AS run FROM m)) WHERE NOT (bot AND size >= 3))"
PEOPLE = f"s AS ({sectioned('f')}), p AS (SELECT *, CASE WHEN author_id = 'error' THEN 0 ELSE dense_rank() OVER (PARTITION BY channel, section ORDER BY CASE WHEN author_id <> 'error' THEN first END NULLS FIRST) - max(CASE WHEN author_id = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY channel, section) END AS person_id FROM (SELECT *, min(id) OVER (PARTITION BY channel, section, author_id) AS first FROM s))"
MERGED = "t AS (SELECT *, sum(start) OVER (PARTITION BY channel, section ORDER BY id) AS turn_idx FROM (SELECT *, CASE WHEN person_id <> lag(person_id) OVER (PARTITION BY channel, section ORDER BY id) THEN 1 ELSE 0 END AS start FROM p)), g AS (SELECT channel, section, turn_idx, person_id, string_agg(content, ' ' ORDER BY id) AS text FROM t GROUP BY ALL)"


@query("sessionize", f"WITH {MSGS} SELECT channel, id, CAST(section AS BIGINT) AS section FROM ({sectioned('m')})")
def sessionize(spark, sf_dir):
    return sessions.sections(messages(spark, sf_dir)).select("channel", "id", F.col("section").cast("long").alias("section"))


@query("section_sizes", f"WITH {MSGS} SELECT n, count(*) AS sections FROM (SELECT count(*) AS n FROM ({sectioned('m')}) GROUP BY channel, section) GROUP BY n")
def section_sizes(spark, sf_dir):
    return sessions.sections(messages(spark, sf_dir)).groupBy("channel", "section").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("sections"))


@query("bot_run_filter", f"WITH {MSGS}, {RUNS} SELECT channel, id, author_id FROM f")
def bot_run_filter(spark, sf_dir):
    return sessions.drop_bot_runs(messages(spark, sf_dir), _bot()).select("channel", "id", "author_id")


def _people(spark, sf_dir):
    rows = sessions.drop_bot_runs(messages(spark, sf_dir), _bot())
    return sessions.person_ids(sessions.sections(rows), _bot())


@query("speaker_ids", f"WITH {MSGS}, {RUNS}, {PEOPLE} SELECT channel, id, CAST(person_id AS BIGINT) AS person_id FROM p")
def speaker_ids(spark, sf_dir):
    return _people(spark, sf_dir).select("channel", "id", F.col("person_id").cast("long").alias("person_id"))


@query("merge_turns", f"WITH {MSGS}, {RUNS}, {PEOPLE}, {MERGED} SELECT channel, CAST(section AS BIGINT) AS section, CAST(turn_idx AS BIGINT) AS turn_idx, CAST(person_id AS BIGINT) AS person_id, text FROM g WHERE (channel, section) IN (SELECT (channel, section) FROM g GROUP BY channel, section HAVING count(*) >= 2)")
def merge_turns(spark, sf_dir):
    turns = sessions.keep_dialogs(sessions.merged_turns(_people(spark, sf_dir)))
    return turns.select("channel", F.col("section").cast("long").alias("section"), F.col("turn_idx").cast("long").alias("turn_idx"), F.col("person_id").cast("long").alias("person_id"), "text")


@query("chat_totals", f"WITH {MSGS}, {RUNS}, {PEOPLE}, {MERGED} SELECT count(DISTINCT (channel, section)) AS sections, count(*) AS turns, CAST(max(person_id) + 1 AS BIGINT) AS persons FROM g")
def chat_totals(spark, sf_dir):
    out = sessions.totals(sessions.merged_turns(_people(spark, sf_dir)))
    return out.select("sections", "turns", F.col("persons").cast("long").alias("persons"))


@query("ranged_turns", ORACLES["merge_turns"])
def ranged_turns(spark, sf_dir):
    """As merge_turns, with each channel cut into ranges of ids."""
    spread = sessions.spread(messages(spark, sf_dir), 12)
    people = sessions.person_ids(sessions.sections(sessions.drop_bot_runs(spread, _bot())), _bot())
    turns = sessions.keep_dialogs(sessions.merged_turns(people))
    return turns.select("channel", F.col("section").cast("long").alias("section"), F.col("turn_idx").cast("long").alias("turn_idx"), F.col("person_id").cast("long").alias("person_id"), "text")


@query("live_turns", f"WITH {MSGS}, f AS (SELECT * FROM m), {PEOPLE}, {MERGED} SELECT CAST(channel AS VARCHAR) AS channel, CAST(section AS BIGINT) AS section, CAST(turn_idx AS BIGINT) AS turn_idx, CAST(person_id AS BIGINT) AS person_id, text FROM g")
def live_turns(spark, sf_dir):
    """Turns of a stream of all messages and one of a later time, whose watermark closes them all."""
    path = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    rows = messages(spark, sf_dir).withColumn("channel", F.col("channel").cast("string"))
    last = rows.agg(F.max("ts_secs").alias("t")).select(F.lit("last").alias("channel"), F.lit(0).cast(rows.schema["id"].dataType).alias("id"), (F.col("t") + 10**6).alias("ts_secs"), F.lit("end").alias("author_id"), F.lit("").alias("content"))
    rows.unionByName(last).write.parquet(f"{path}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, live.PROVIDER)
    try:
        stream = live.live_turns(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), _bot(), "1 hour")
        run = stream.writeStream.trigger(availableNow=True).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{path}/out").where("channel <> 'last' and not late").select("channel", "section", "turn_idx", "person_id", "text")


@query("sliding_windows", f"WITH {MSGS}, r AS (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY id) - 1 AS i FROM m) SELECT channel, CAST(win AS BIGINT) AS win, CAST(i - 15 * win AS BIGINT) AS position, id FROM (SELECT *, unnest(range(0, i // 15 + 1)) AS win FROM r) WHERE i - 15 * win < 20")
def sliding_windows(spark, sf_dir):
    return sessions.sliding_windows(messages(spark, sf_dir)).select("channel", F.col("window").cast("long").alias("win"), F.col("position").cast("long").alias("position"), "id")


@query("channel_history20", f"WITH {MSGS} SELECT channel, id, content FROM m QUALIFY row_number() OVER (PARTITION BY channel ORDER BY id DESC) <= 20")
def channel_history20(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("id")))
    return messages(spark, sf_dir).withColumn("nth", nth).where("nth <= 20").select("channel", "id", "content")


@query("person_assign", "WITH u AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id) SELECT CAST(1 + row_number() OVER (ORDER BY first, user_id) - 1 AS BIGINT) AS person_id, user_id, 'user ' || user_id AS display_name FROM u UNION ALL SELECT 0, -1, 'bot'")
def person_assign(spark, sf_dir):
    bot = persons.ensure_bot(spark.createDataFrame([], "person_id long, user_id long, display_name string"), -1, "bot")
    users = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("display_name"), F.col("event_id").alias("first_seen"))
    return persons.assign(bot, users)


# ---- examples -----------------------------------------------------------------------------------

WRAPPED = f"x AS (SELECT section_idx, turn_idx, person_id, {tokens()} AS tokens FROM turns), q AS (SELECT *, list_concat(['<PERSON_' || person_id || '>'], tokens, ['</PERSON_' || person_id || '>']) AS query FROM x), e AS (SELECT *, lead(person_id) OVER o AS target_person_id, lead(tokens) OVER o AS next, flatten(list(query) OVER (PARTITION BY section_idx ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS prelude FROM q WINDOW o AS (PARTITION BY section_idx ORDER BY turn_idx))"


@query("train_pairs", f"WITH {TURNS}, {WRAPPED} SELECT section_idx, turn_idx, array_to_string(query, ' ') AS query, CAST(target_person_id AS INTEGER) AS target_person_id, array_to_string(next[1:20], ' ') AS target FROM e WHERE len(next) > 0")
def train_pairs(spark, sf_dir):
    return vocabulary.examples(turns_of(spark, sf_dir)).select("section_idx", "turn_idx", F.array_join("query", " ").alias("query"), "target_person_id", F.array_join("target_tokens", " ").alias("target"))


@query("prelude_lengths", f"WITH {TURNS}, {WRAPPED} SELECT section_idx, turn_idx, CAST(coalesce(len(prelude), 0) AS BIGINT) AS n, coalesce(md5(array_to_string(prelude, ' ')), md5('')) AS prelude_md5 FROM e WHERE len(next) > 0")
def prelude_lengths(spark, sf_dir):
    return vocabulary.examples(turns_of(spark, sf_dir)).select("section_idx", "turn_idx", F.size("prelude").cast("long").alias("n"), F.md5(F.array_join("prelude", " ")).alias("prelude_md5"))


@query("training_windows", f"""WITH {TURNS}, {VOCAB}, {WRAPPED}, v AS (SELECT token, max(id) AS id FROM vocab GROUP BY token),
 b AS (SELECT section_idx, turn_idx, list_concat(coalesce(prelude, []), query, ['<PERSON_' || target_person_id || '>']) AS before, list_concat(next[1:20], ['</PERSON_' || target_person_id || '>']) AS spoken FROM e WHERE len(next) > 0),
 st AS (SELECT section_idx, turn_idx, before, spoken, unnest(range(0, len(spoken))) AS step FROM b),
 c AS (SELECT section_idx, turn_idx, step, spoken[step + 1] AS label, list_concat(before, spoken[1:step])[-32:] AS context FROM st),
 wt AS (SELECT section_idx, turn_idx, step, label, unnest(context) AS token, generate_subscripts(context, 1) AS pos FROM c),
 wi AS (SELECT section_idx, turn_idx, step, label, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM wt LEFT JOIN v USING (token) GROUP BY ALL)
 SELECT section_idx, turn_idx, CAST(step AS BIGINT) AS step, array_to_string(list_concat(list_transform(range(0, 32 - len(ids)), lambda z: 0), ids), ',') AS win, CAST(v.id AS BIGINT) AS label_id FROM wi JOIN v ON v.token = wi.label""")
def training_windows(spark, sf_dir):
    turns = turns_of(spark, sf_dir)
    out = vocabulary.training_windows(turns, vocabulary.vocabulary(turns))
    return out.select("section_idx", "turn_idx", F.col("step").cast("long").alias("step"), F.array_join(F.col("window").cast("array<string>"), ",").alias("win"), "label_id")


@query("val_split", f"WITH {TURNS}, {WRAPPED}, k AS (SELECT section_idx, turn_idx, row_number() OVER (ORDER BY section_idx, turn_idx) AS nth, count(*) OVER () AS n FROM e WHERE len(next) > 0) SELECT section_idx, turn_idx, nth > n - least(greatest(CAST(round(n * 0.1) AS BIGINT), 1), n - 1) AS is_val FROM k")
def val_split(spark, sf_dir):
    rows = vocabulary.examples(turns_of(spark, sf_dir)).select("section_idx", "turn_idx")
    return vocabulary.validation_split(rows, 0.1, ["section_idx", "turn_idx"], rows.count())


EXAMPLE_KEYS = f"{TURNS}, {WRAPPED}, k AS (SELECT section_idx, turn_idx, row_number() OVER (ORDER BY section_idx, turn_idx) AS nth, count(*) OVER () AS n FROM e WHERE len(next) > 0)"


@query("val_split_capped", f"WITH {EXAMPLE_KEYS}, v AS (SELECT *, n - least(greatest(CAST(round(n * 0.2) AS BIGINT), 1), n - 1) AS train FROM k) SELECT section_idx, turn_idx, nth > train AS is_val FROM v WHERE nth <= 70 OR nth > train AND nth - train <= 30")
def val_split_capped(spark, sf_dir):
    rows = vocabulary.examples(turns_of(spark, sf_dir)).select("section_idx", "turn_idx")
    return vocabulary.validation_split(rows, 0.2, ["section_idx", "turn_idx"], rows.count(), 70, 30)


@query("pretrain_split", f"WITH {EXAMPLE_KEYS} SELECT section_idx, turn_idx, nth > n - least(greatest(n // 10, 1), n - 1) AS is_val FROM k")
def pretrain_split(spark, sf_dir):
    rows = vocabulary.examples(turns_of(spark, sf_dir)).select("section_idx", "turn_idx")
    return vocabulary.pretrain_split(rows, ["section_idx", "turn_idx"], rows.count())


@query("prefix_histogram", f"WITH {NOISY} SELECT lower(array_to_string(({w()})[1:3], ' ')) AS prefix, count(*) AS turns FROM noisy WHERE {PREFIX} GROUP BY 1")
def prefix_histogram(spark, sf_dir):
    return vocabulary.prefix_histogram(noisy(spark, sf_dir))


def _count(source: str) -> str:
    return f"(SELECT count(*) FROM {source})"


def _sections(source: str) -> str:
    return f"(SELECT count(DISTINCT section_idx) FROM {source})"


def _changed(before: str, after: str) -> str:
    return f"(SELECT count(*) FROM {before} x JOIN {after} y USING (section_idx, turn_idx) WHERE x.text <> y.text)"


def _hits(source: str, pattern: str) -> dict[str, str]:
    return {"n": f"(SELECT coalesce(sum({hits(pattern)}), 0) FROM {source})", "touched": f"(SELECT count(*) FROM {source} WHERE {hits(pattern)} > 0)"}


#: Counters by name; how many decorations a text had has no plain SQL and is tested on known texts.
COUNTERS = {
    "sections_before": _sections("noisy"),
    "turns_before": _count("noisy"),
    "sections_after": _sections("short_last"),
    "turns_after": _count("short_last"),
    "sec_monologue": "(SELECT count(*) FROM (SELECT section_idx FROM noisy GROUP BY section_idx HAVING max(person_id) = 0 AND min(person_id) = 0))",
    "sec_single_speaker": "(SELECT count(*) FROM (SELECT section_idx FROM noisy GROUP BY section_idx HAVING max(person_id) = min(person_id) AND max(person_id) <> 0))",
    "sec_too_short": f"{_sections('one_sided')} - {_sections('short_last')}",
    "turn_url_dominant": f"(SELECT count(*) FROM one_sided WHERE {URL_ONLY})",
    "turn_no_alphanum": f"(SELECT count(*) FROM one_sided WHERE NOT {URL_ONLY} AND {WORDLESS})",
    "turn_role_ping": f"(SELECT count(*) FROM one_sided WHERE NOT {URL_ONLY} AND NOT {WORDLESS} AND {PING_ONLY})",
    "turn_dedup_cap": f"{_count('turns_')} - {_count('repeats')}",
    "turn_prefix_cap": f"{_count('short_again')} - {_count('prefixes')}",
    "url_tokens": _hits("short", URL)["n"],
    "url_turns": _hits("short", URL)["touched"],
    "mention_tokens": _hits("urls", MENTION)["n"],
    "mention_turns": _hits("urls", MENTION)["touched"],
    "emoji_tokens": _hits("mentions", EMOJI)["n"],
    "emoji_turns": _hits("mentions", EMOJI)["touched"],
    "markdown_turns": _changed("emoji", "markdown"),
    "escape_chars": "(SELECT coalesce(sum(length(text) - length(replace(text, chr(92), ''))), 0) FROM markdown)",
    "escape_turns": "(SELECT count(*) FROM markdown WHERE contains(text, chr(92)))",
}


@query("clean_counters", f"WITH {CLEANED} " + " UNION ALL ".join(f"SELECT '{k}' AS counter, CAST({v} AS BIGINT) AS n" for k, v in COUNTERS.items()))
def clean_counters(spark, sf_dir):
    return cleaning.counters(_turn_cols(noisy(spark, sf_dir))).where("counter <> 'markdown_tokens'")


@query("window_boundaries", f"WITH {MSGS}, r AS (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY id) - 1 AS i FROM m), x AS (SELECT *, unnest(range(0, i // 15 + 1)) AS win FROM r) SELECT DISTINCT channel, id FROM x WHERE i - 15 * win < 20 AND i - 15 * win IN (3, (win % 17) + 1)")
def window_boundaries(spark, sf_dir):
    """A stand-in for the outside model names position 0, 3, one that moves with the window and one beyond it."""
    rows = messages(spark, sf_dir)
    windows = sessions.sliding_windows(rows).select("channel", "window").distinct()
    answer = F.concat(F.lit("Sections start at [0, 3, 99, "), ((F.col("window") % 17) + 1).cast("string"), F.lit("]."))
    return sessions.window_boundaries(rows, windows.withColumn("answer", answer))


# ---- vectors ------------------------------------------------------------------------------------

@query("label_centroids", "SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) + 0.0 AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY label, dim")
def label_centroids(spark, sf_dir):
    return retrieval.group_means(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "dim", (F.round("mean", 6) + 0.0).alias("mean"))


@query("cosine_topk", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))) AS score FROM e, q) SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 5")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k_each(e, queries, 5, "vec_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


MEMORY = ["the", "of", "and", "with", "is", "to", "that", "thing"]


POSITIONAL = f"""WITH x AS (SELECT section_idx, turn_idx, {tokens()} AS tokens FROM turns), t AS (SELECT section_idx, flatten(list(tokens ORDER BY turn_idx))[1:{len(MEMORY)}] AS said FROM x GROUP BY section_idx),
 z AS (SELECT section_idx, a, ({MEMORY!r})[i] AS b FROM (SELECT section_idx, unnest(said) AS a, generate_subscripts(said, 1) AS i FROM t))
 SELECT section_idx, CAST(coalesce(sum(CASE WHEN a = b THEN 100 ELSE least(255, greatest(strlen(a) - strlen(b), 0) % 256 + len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] = b[i]))) END), 0) AS BIGINT) AS score FROM (SELECT DISTINCT section_idx FROM turns) LEFT JOIN z USING (section_idx) GROUP BY section_idx"""


@query("positional_similarity", f"WITH {TURNS}, sc AS ({POSITIONAL}) SELECT * FROM sc")
def positional_similarity(spark, sf_dir):
    return retrieval.section_similarity(turns_of(spark, sf_dir), MEMORY)


def _vectors(spark, sf_dir, vocab):
    """(id, vec): the embedding of token id i is row i % n of the n embeddings, as the networks here have no table of this size."""
    e = table(spark, sf_dir, "embeddings")
    return vocab.select("id", (F.col("id") % e.count()).alias("vec_id")).join(e, "vec_id").select("id", F.col("embedding").alias("vec"))


def _turn_vectors(spark, sf_dir):
    turns = turns_of(spark, sf_dir)
    vocab = vocabulary.vocabulary(turns)
    return turns, retrieval.turn_centroids(turns, vocab, _vectors(spark, sf_dir, vocab), 64)


_CENTROIDS = f"v AS (SELECT token, max(id) AS id FROM vocab GROUP BY token), w AS (SELECT section_idx, turn_idx, unnest({tokens()}) AS token FROM turns), c AS (SELECT section_idx, turn_idx, dim, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT section_idx, turn_idx, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM w JOIN v USING (token) JOIN embeddings ON vec_id = v.id % (SELECT count(*) FROM embeddings) WHERE v.id > 1) GROUP BY ALL)"


@query("turn_centroids", f"WITH {TURNS}, {VOCAB}, {_CENTROIDS} SELECT section_idx, turn_idx, CAST(dim AS INTEGER) AS dim, round(x, 6) + 0.0 AS x FROM c UNION ALL SELECT section_idx, turn_idx, CAST(unnest(range(0, 64)) AS INTEGER), 0.0 FROM turns WHERE (section_idx, turn_idx) NOT IN (SELECT (section_idx, turn_idx) FROM c)")
def turn_centroids(spark, sf_dir):
    _, vectors = _turn_vectors(spark, sf_dir)
    return vectors.select("section_idx", "turn_idx", F.posexplode("embedding").alias("dim", "x")).select("section_idx", "turn_idx", "dim", (F.round("x", 6) + 0.0).alias("x"))


@query("index_rows", f"WITH {TURNS}, {VOCAB}, {_CENTROIDS} SELECT t.section_idx, t.turn_idx, '<PERSON_' || person_id || '> ' || array_to_string({tokens()}, ' ') || ' </PERSON_' || person_id || '>' AS entry, round(coalesce((SELECT sum(x * x) FROM c WHERE c.section_idx = t.section_idx AND c.turn_idx = t.turn_idx), 0), 5) + 0.0 AS norm FROM turns t WHERE len({tokens()}) > 0")
def index_rows(spark, sf_dir):
    turns = turns_of(spark, sf_dir)
    vocab = vocabulary.vocabulary(turns)
    index = retrieval.build_index(turns, vocab, _vectors(spark, sf_dir, vocab), 64)
    norm = F.round(V.dot(F.col("embedding"), F.col("embedding")), 5) + 0.0
    return index.select("section_idx", "turn_idx", retrieval.rendered(F.col("person_id"), F.col("tokens")).alias("entry"), norm.alias("norm"))


@query("recall_scores", f"""WITH {TURNS}, {VOCAB}, {_CENTROIDS}, q AS (SELECT section_idx AS seq, dim, x AS y FROM c WHERE turn_idx = 0 AND section_idx % 20 = 0), n AS (SELECT section_idx, turn_idx, sqrt(sum(x * x)) AS norm FROM c GROUP BY ALL),
 d AS (SELECT seq, section_idx, turn_idx, sum(x * y) AS dot, sqrt(sum(y * y)) AS norm FROM q JOIN c USING (dim) GROUP BY ALL), s AS (SELECT seq, dot / (d.norm * n.norm) AS score FROM d JOIN n USING (section_idx, turn_idx))
 SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY score DESC) AS INTEGER) AS rank, round(score, 5) AS score FROM s QUALIFY rank <= 5""")
def recall_scores(spark, sf_dir):
    """How near the five turns are that the index recalls for the first turns of every twentieth conversation."""
    turns = turns_of(spark, sf_dir)
    vocab = vocabulary.vocabulary(turns)
    vectors = _vectors(spark, sf_dir, vocab)
    index = retrieval.build_index(turns, vocab, vectors, 64)
    asked = index.where("turn_idx = 0 and section_idx % 20 = 0").select(F.col("section_idx").alias("query_id"), F.col("embedding").alias("query"))
    near = retrieval.top_k_each(index, asked, 5, ["section_idx", "turn_idx"])
    return near.select(F.col("query_id").alias("seq"), "rank", F.round("score", 5).alias("score"))


@query("chat_service", f"""WITH {TURNS}, r AS (SELECT section_idx * 1000 + turn_idx AS seq, section_idx, text, section_idx % 7 = 0 AS strange FROM turns WHERE person_id = 1),
 f AS (SELECT seq, least(5, (SELECT count(*) FROM turns WHERE len({tokens()}) > 0)) + least(20, 2 * row_number() OVER (PARTITION BY section_idx ORDER BY seq) - 2) AS n FROM r WHERE NOT strange AND text <> '')
 SELECT CAST(seq AS BIGINT) AS seq, CASE WHEN strange THEN 401 WHEN text = '' THEN 400 ELSE 200 END AS status, CASE WHEN strange THEN 'unauthorized' WHEN text = '' THEN 'missing or empty ' || chr(39) || 'input' || chr(39) ELSE '{{"reply":"' || length(text) || ' characters after ' || n || ' entries"}}' END AS body FROM r LEFT JOIN f USING (seq)""")
def chat_service(spark, sf_dir):
    """Responses to all user turns, each conversation a channel, by an answerer that tells what it was given; every seventh has no key."""
    path = f"{shared_folder(spark)}/service-{uuid.uuid4().hex}"
    said = turns_of(spark, sf_dir)
    vocab = checkpointed(vocabulary.vocabulary(said))
    vectors = checkpointed(_vectors(spark, sf_dir, vocab))
    retrieval.put(retrieval.build_index(said, vocab, vectors, 64), f"{path}/index")
    body = F.to_json(F.struct(F.col("text").alias("input"), F.col("section_idx").cast("string").alias("channel_id")))
    key = F.when(F.col("section_idx") % 7 != 0, F.lit("key"))
    asked = said.where("person_id = 1").select((F.col("section_idx") * 1000 + F.col("turn_idx")).cast("long").alias("seq"), key.alias("api_key"), body.alias("body"))
    asked.write.parquet(f"{path}/requests")

    def answer(rows: DataFrame) -> DataFrame:
        return rows.select("channel", "seq", F.concat(F.length("input").cast("string"), F.lit(" characters after "), F.size("memory").cast("string"), F.lit(" entries")).alias("reply"))

    run = service.serve(spark.readStream.schema(asked.schema).parquet(f"{path}/requests"), "key", f"{path}/index", vocab, vectors, 64, answer, path)
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.parquet(f"{path}/responses").select("seq", "status", "body")


@query("teacher_next_turn", f"""WITH {TURNS}, {VOCAB}, {_CENTROIDS}, sc AS ({POSITIONAL}), b AS (SELECT section_idx FROM sc ORDER BY score DESC, section_idx LIMIT 1),
 o AS (SELECT section_idx, turn_idx, {tokens()} AS tokens, lead(text) OVER (ORDER BY turn_idx) AS next_text FROM turns WHERE section_idx IN (SELECT section_idx FROM b)),
 q AS (SELECT unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings WHERE vec_id = 3),
 d AS (SELECT section_idx, turn_idx, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS score FROM c JOIN q USING (dim) GROUP BY section_idx, turn_idx),
 best AS (SELECT section_idx, turn_idx, coalesce(score, 0) AS score, next_text FROM o LEFT JOIN d USING (section_idx, turn_idx) WHERE len(tokens) > 0 ORDER BY 3 DESC, turn_idx LIMIT 1)
 SELECT section_idx, turn_idx, round(score, 6) AS score, next_text FROM best WHERE next_text IS NOT NULL""")
def teacher_next_turn(spark, sf_dir):
    turns, vectors = _turn_vectors(spark, sf_dir)
    first = table(spark, sf_dir, "embeddings").where("vec_id = 3").select("embedding").first()
    out = retrieval.teacher_reply(turns, MEMORY, vectors, F.array(*[F.lit(float(x)) for x in first[0]]))
    return out.select("section_idx", "turn_idx", F.round("score", 6).alias("score"), "next_text")


# ---- texts --------------------------------------------------------------------------------------

def _cut(mark: str) -> str:
    return f"len(late) - instr(reverse(late), '{mark[::-1]}')"


@query("truncate_sentence", f"WITH d AS (SELECT doc_id, text, text[301:400] AS late FROM documents) SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE regexp_replace(text[1:CASE WHEN contains(late, '. ') THEN 300 + {_cut('. ')} WHEN contains(late, '! ') THEN 300 + {_cut('! ')} WHEN contains(late, '? ') THEN 300 + {_cut('? ')} ELSE 400 END], '\\s+$', '') END AS text FROM d")
def truncate_sentence(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.truncate_at_sentence(F.col("text")).alias("text"))


@query("split_sentences", r"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n, array_to_string(s, '|') AS sentences FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(translate(text, chr(10) || chr(13) || chr(9), '   '), '([.!?])(\s|$)', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""")
def split_sentences(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("sentences"))


@query("sanitize_texts", f"SELECT page_id, {tidy('''translate(html, '<>' || chr(10) || chr(13) || chr(9), '()   ')''')} AS plain, CASE WHEN length({tidy('html')}) > 240 THEN ({tidy('html')})[1:237] || '...' ELSE {tidy('html')} END AS prompt FROM pages")
def sanitize_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize(F.col("html")).alias("plain"), T.sanitize_prompt(F.col("html")).alias("prompt"))


@query("detokenize", f"WITH {TURNS} SELECT section_idx, turn_idx, regexp_replace(array_to_string(list_transform({tokens()}, lambda t: CASE WHEN regexp_matches(t, '[\\p{{L}}\\p{{N}}'']') THEN ' ' || t ELSE t END), ''), '^ ', '') AS text FROM turns")
def detokenize(spark, sf_dir):
    return turns_of(spark, sf_dir).select("section_idx", "turn_idx", T.detokenize(T.tokenize(F.col("text"))).alias("text"))


@query("dialog_lines", f"WITH {TURNS}, l AS (SELECT section_idx, string_agg(text, ' __eou__ ' ORDER BY turn_idx) AS value FROM turns GROUP BY section_idx), p AS (SELECT section_idx, list_filter(list_transform(string_split(value, '__eou__'), lambda x: trim(translate(x, '<>', '()'))), lambda x: x <> '') AS p FROM l) SELECT section_idx, CAST(unnest(range(0, len(p))) AS BIGINT) AS turn_idx, CAST((unnest(range(0, len(p))) + 1) % 2 AS INTEGER) AS person_id, unnest(p) AS text FROM p WHERE len(p) >= 2")
def dialog_lines(spark, sf_dir):
    pieces = F.array_sort(F.collect_list(F.struct("turn_idx", "text")))
    lines = turns_of(spark, sf_dir).groupBy("section_idx").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), " __eou__ ").alias("value"))
    return ingest.dialog_lines(lines)


@query("story_turns", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(translate(text, chr(10) || chr(13) || chr(9), '   '), '([.!?])(\s|$)', '\1' || chr(10), 'g'), chr(10)), lambda x: array_to_string(list_filter(regexp_split_to_array(translate(x, '<>', '()'), '\s+'), lambda w: w <> ''), ' ')), lambda x: len(string_split(x, ' ')) BETWEEN 3 AND 18) AS s FROM documents), k AS (SELECT * FROM s WHERE len(s) >= 2) SELECT doc_id AS section_idx, CAST(unnest(range(0, len(s))) AS BIGINT) AS turn_idx, 0 AS person_id, unnest(s) AS text FROM k""")
def story_turns(spark, sf_dir):
    return ingest.story_turns(documents(spark, sf_dir).select(F.col("doc_id").alias("section_idx"), F.col("text").alias("value")))


TREE = """nodes AS (SELECT conv_id AS tree_id, turn AS node_id, CASE WHEN turn > 0 THEN turn - 1 - (turn % 2) * (turn // 3) % 2 END AS parent_id, turn AS pos, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST((turn * 7 + conv_id) % 5 AS INTEGER) END AS rank, role, text FROM conversations)"""


@query("tree_thread", f"""WITH RECURSIVE {TREE}, best AS (SELECT * FROM nodes WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY coalesce(rank, 999), pos) = 1),
 path AS (SELECT tree_id, 0 AS depth, node_id FROM nodes WHERE parent_id IS NULL UNION ALL SELECT p.tree_id, p.depth + 1, b.node_id FROM path p JOIN best b ON b.tree_id = p.tree_id AND b.parent_id = p.node_id WHERE p.depth < 5)
 SELECT tree_id, depth, node_id FROM path""")
def tree_thread(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") > 0, F.expr("turn - 1 - (turn % 2) * (turn div 3) % 2"))
    nodes = c.select(F.col("conv_id").alias("tree_id"), F.col("turn").alias("node_id"), parent.alias("parent_id"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 != 0, ((F.col("turn") * 7 + F.col("conv_id")) % 5).cast("int")).alias("rank"), "role", "text")
    return ingest.tree_paths(nodes).select("tree_id", "depth", "node_id")


# ---- numbers ------------------------------------------------------------------------------------

@query("lr_schedule", "SELECT CAST(e AS BIGINT) AS epoch, round(CASE WHEN e <= 3 THEN 0.001 * e / 3 WHEN e - 3 >= 10 THEN 0.00001 ELSE 0.00001 + (0.001 - 0.00001) * 0.5 * (1 + cos(pi() * (e - 3) / 10)) END, 9) AS lr FROM (SELECT unnest(range(1, 21)) AS e)")
def lr_schedule(spark, sf_dir):
    return spark.range(1, 21).select(F.col("id").alias("epoch"), F.round(V.learning_rate(F.col("id"), 0.001, 0.00001, 3, 10), 9).alias("lr"))


@query("softmax_mask", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS z FROM e), p AS (SELECT vec_id, list_transform(z, lambda v: v / list_sum(z)) AS p FROM s)
 SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(CASE WHEN i IN (2, 4) THEN 0 ELSE p[i] * CASE i WHEN 1 THEN 0.25 WHEN 3 THEN 0.5 ELSE 1 END END, 6) AS p FROM (SELECT vec_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)""")
def softmax_mask(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p = V.repetition_penalty(V.mask(V.softmax(F.col("x")), F.array(F.lit(1), F.lit(3))), F.array(F.lit(0), F.lit(0), F.lit(2)), 0.5)
    return e.select("vec_id", F.posexplode(p).alias("i", "p")).select("vec_id", "i", F.round("p", 6).alias("p"))


@query("greedy_ids", "WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) - 1 AS INTEGER) AS place, CAST(i AS INTEGER) AS id FROM e QUALIFY place < 5")
def greedy_ids(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.top_k_ids(F.col("embedding"), 5)).alias("place", "id"))


@query("cross_entropy", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), z AS (SELECT vec_id, label, list_transform(x, lambda v: exp(v - list_max(x))) AS z FROM e)
 SELECT label, round(avg(-ln(greatest(z[1 + vec_id % len(z)] / list_sum(z), 1e-9))), 6) AS loss, count(*) AS n FROM z GROUP BY label""")
def cross_entropy(spark, sf_dir):
    """Each vector is a row of logits, and its target the place that its id names."""
    p = V.softmax(F.col("embedding").cast("array<double>"))
    target = F.element_at(p, (1 + F.col("vec_id") % F.size("embedding")).cast("int"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(V.cross_entropy(target)), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("corpus_shares", f"WITH {NOISY} SELECT CAST(person_id AS INTEGER) AS person_id, count(*) AS turns, count(*) FILTER (len({w()}) >= 3) AS long_turns, count(DISTINCT section_idx) AS sections FROM noisy GROUP BY person_id")
def corpus_shares(spark, sf_dir):
    return noisy(spark, sf_dir).groupBy(F.col("person_id").cast("int").alias("person_id")).agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.size(T.words(F.col("text"))) >= 3).alias("long_turns"), F.countDistinct("section_idx").alias("sections"))
