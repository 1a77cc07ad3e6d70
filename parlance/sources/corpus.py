"""The tagged text corpus: <SEC> and <PERSON_n> text </PERSON_n>, by white-space tokens.

A file is read in splits, each by a task of its own. One pass sums a split up: its tokens, its tags
and what is wrong between them, its sections and turns. The sums of all splits, one small row each,
are combined in order, which tells in what state each split begins: in which section, after how many
turns, inside whose turn. A second pass replays each split from there. Texts are never shuffled but
for turns that reach over the end of a split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.sources import files
from parlance.sources.splits import lines as split_lines

#: Part of the key of cached turns; another layout of theirs needs another number.
CACHE_VERSION = 2
SCHEMA = "section_idx bigint, turn_idx bigint, person_id bigint, text string"

# Unicode white space, which words are split at, and the tags.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_word = re.compile(rf"[^{SPACE}]+")
_tag = re.compile(rf"(?<![^{SPACE}])(?:({T.SEC})|<(/?)PERSON_\+?([0-9]{{1,18}})>)(?![^{SPACE}])")
MOST_PERSON = 4294967295


def _events(value: str) -> Iterator[tuple[str, str, int | None, int, int]]:
    """(kind, token, person, start, end) of each tag of a line; kind is sec, open or close."""
    if "<" in value:
        for m in _tag.finditer(value):
            if m[1]:
                yield "sec", m[0], None, *m.span()
            elif int(m[3]) <= MOST_PERSON:
                yield "close" if m[2] else "open", m[0], int(m[3]), *m.span()


def _broken(kind: str, person: int | None, inside: int | None) -> str | None:
    """What is wrong with a tag after one that left the turn of `inside` open, or none."""
    if kind == "close":
        return "close without open" if inside is None else "close of another person" if person != inside else None
    return None if inside is None else "section inside a turn" if kind == "sec" else "turn inside a turn"


_SUMMARY = "file string, block long, tokens long, first struct<kind: string, token: string, person: long, pos: long>, last struct<kind: string, token: string, person: long, pos: long>, error struct<pos: long, token: string, error: string>, head long, cuts boolean, sections long, tail long"


class _Summary:
    """What one split does to the state that comes in.

    head and tail are the turns that end before its first and after its last section tag, cuts says
    whether there is one, and sections how many sections with turns lie between. A first tag that
    closes a turn counts in none of them: whether it does depends on the state.
    """

    def __init__(self, file: str, block: int):
        self.file, self.block, self.tokens = file, block, 0
        self.first = self.last = self.error = None
        self.head = self.sections = self.tail = 0
        self.cuts = False

    def add(self, value: str) -> None:
        at = 0
        for kind, token, person, start, end in _events(value):
            self.tokens += len(_word.findall(value, at, start))
            tag = {"kind": kind, "token": token, "person": person, "pos": self.tokens}
            if self.first is None:
                self.first = tag
            else:
                inside = self.last["person"] if self.last["kind"] == "open" else None
                wrong = _broken(kind, person, inside)
                if wrong and self.error is None:
                    self.error = {"pos": self.tokens, "token": token, "error": wrong}
                if kind == "close" and inside is not None:
                    self.tail += 1
            if kind == "sec":
                if self.cuts:
                    self.sections += self.tail > 0
                else:
                    self.head, self.cuts = self.tail, True
                self.tail = 0
            self.last = tag
            self.tokens += 1
            at = end
        self.tokens += len(_word.findall(value, at))

    def row(self) -> dict:
        return dict(vars(self)) if self.cuts else vars(self) | {"head": self.tail, "tail": 0}


def _by_block(batches, columns: list[str]):
    """Each split's rows, a list a batch, as ((file, block, ...), values); a split's rows stand together and in order."""
    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in columns]
        values = batch.column("value").to_pylist()
        at = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or any(k[i] != k[at] for k in keys[:2]):
                yield tuple(k[at] for k in keys), values[at:i]
                at = i


def summaries(raw: DataFrame) -> DataFrame:
    """One row for each split of lines (file, block, value)."""

    def run(batches):
        now, done = None, []
        for (file, block), values in _by_block(batches, ["file", "block"]):
            if now is None or (now.file, now.block) != (file, block):
                if now:
                    done.append(now.row())
                now = _Summary(file, block)
            for v in values:
                now.add(v or "")
        if now:
            done.append(now.row())
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    schema = pa.schema(
        [
            ("file", pa.string()), ("block", pa.int64()), ("tokens", pa.int64()),
            *((c, pa.struct([("kind", pa.string()), ("token", pa.string()), ("person", pa.int64()), ("pos", pa.int64())])) for c in ("first", "last")),
            ("error", pa.struct([("pos", pa.int64()), ("token", pa.string()), ("error", pa.string())])),
            ("head", pa.int64()), ("cuts", pa.bool_()), ("sections", pa.int64()), ("tail", pa.int64()),
        ]
    )
    return raw.select("file", "block", "value").mapInArrow(run, _SUMMARY)


def combined(found: list) -> tuple[list[tuple], list[tuple]]:
    """(file, block, section, turn, person, origin, crosses) at the start of each split, and (file, pos, token, error) of what is broken.

    found are the splits' summaries. section numbers those with turns over all files in order of their
    paths; person is whose turn is open, and origin the split that it was opened in; crosses says
    whether a turn reaches over either end.
    """
    states, broken = [], []
    section = turn = pos = 0
    inside = opened = origin = file = None

    def finish():
        if inside is not None:
            broken.append((file, opened["pos"], opened["token"], "turn without end"))

    for s in sorted(found, key=lambda s: (s["file"], s["block"])):
        if s["file"] != file:
            finish()
            section, turn, pos, inside, file = section + (turn > 0), 0, 0, None, s["file"]
        first, last = s["first"], s["last"]
        before = (section, turn, inside, origin)
        if first:
            if wrong := _broken(first["kind"], first["person"], inside):
                broken.append((file, pos + first["pos"], first["token"], wrong))
            if s["error"]:
                broken.append((file, pos + s["error"]["pos"], s["error"]["token"], s["error"]["error"]))
            turn += s["head"] + (first["kind"] == "close" and inside is not None)
            if s["cuts"]:
                section, turn = section + (turn > 0) + s["sections"], s["tail"]
            inside = last["person"] if last["kind"] == "open" else None
            opened, origin = {"pos": pos + last["pos"], "token": last["token"]}, s["block"]
        pos += s["tokens"]
        states.append((file, s["block"], *before, before[2] is not None or inside is not None))
    finish()
    return states, broken


def _replayed(rows: DataFrame, whole: bool) -> DataFrame:
    """Turns of lines that carry the state at their split's start: whole ones, or the parts of those that cross an end.

    All parts of a turn have one origin; the last one, if the turn is closed, tells its place.
    """
    kinds = {"section_idx": pa.int64(), "turn_idx": pa.int64(), "person_id": pa.int64(), "text": pa.string()}
    kinds |= {} if whole else {"file": pa.string(), "origin": pa.int64(), "part": pa.int64(), "closed": pa.bool_()}
    schema = pa.schema(list(kinds.items()))

    def run(batches):
        at = person = origin = None
        section = turn = 0
        pieces: list[str] = []
        out = []

        def give(closed: bool) -> None:
            """At a closing tag, or at the end of the split."""
            crosses = origin is not None or not closed
            if crosses != whole:
                out.append((section, turn, person, " ".join(pieces), *(() if whole else (at[0], at[1] if origin is None else origin, at[1], closed))))

        for (file, block, *state), values in _by_block(batches, ["file", "block", "section", "turn", "person", "origin"]):
            if at != (file, block):
                if person is not None:
                    give(False)
                at, (section, turn, person, origin), pieces = (file, block), state, []
            for value in values:
                value, last = value or "", 0
                for kind, _, who, start, end in _events(value):
                    if person is not None and kind == "close":
                        pieces += _word.findall(value, last, start)
                        give(True)
                        turn += 1
                    if kind == "sec":
                        section, turn = section + (turn > 0), 0
                    person, origin, pieces, last = who if kind == "open" else None, None, [], end
                if person is not None:
                    pieces += _word.findall(value, last)
            yield from _batch(out, schema)
        if person is not None:
            give(False)
        yield from _batch(out, schema)

    return rows.select("file", "block", "section", "turn", "person", "origin", "value").mapInArrow(run, SCHEMA if whole else f"{SCHEMA}, file string, origin long, part long, closed boolean")


def _batch(rows: list[tuple], schema: pa.Schema):
    """The rows, if there are any, as a batch; the list is emptied."""
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()


def _located(raw: DataFrame) -> DataFrame:
    """raw with a split for each row, if it says nothing of splits."""
    return raw if "block" in raw.columns else raw.withColumn("block", F.lit(0).cast("bigint"))


def errors(raw: DataFrame) -> DataFrame:
    """(file, pos, token, error) of tags that don't alternate, the first inside each split and those at its ends: only these break a corpus."""
    _, broken = combined(summaries(_located(raw)).collect())
    return raw.sparkSession.createDataFrame(broken, "file string, pos long, token string, error string")


def parse(raw: DataFrame, check: bool = True) -> DataFrame:
    """Turns of raw (file, value), or of lines (file, block, value) as they are scanned; sections with turns are numbered over the files in their order.

    Raises on broken tags if check. Without, a turn that another tag ends is no turn, and a close without open is passed over.
    The driver gets one row of numbers for each split.
    """
    raw = _located(raw)
    states, broken = combined(summaries(raw).collect())
    if check and broken:
        file, pos, token, error = broken[0]
        raise ValueError(f"{error}: {token} at {pos} of {file}")
    kept = raw.sparkSession.createDataFrame(states, "file string, block long, section long, turn long, person long, origin long, crosses boolean")
    out = _replayed(raw.join(F.broadcast(kept), ["file", "block"]), True)  # a row a split
    if any(s[-1] for s in states):
        parts = _replayed(raw.join(F.broadcast(kept.where("crosses")), ["file", "block"]), False)
        pieces = F.array_sort(F.collect_list(F.struct("part", "text")))
        end = F.max_by(F.struct("section_idx", "turn_idx", "person_id", "closed"), "part")
        joined = parts.groupBy("file", "origin").agg(end.alias("end"), F.array_join(F.filter(F.transform(pieces, lambda p: p["text"]), lambda t: t != ""), " ").alias("text"))
        joined = joined.where("end.closed").select("end.section_idx", "end.turn_idx", "end.person_id", "text")
        out = out.unionByName(joined)
    return out


def read(spark: SparkSession, path: str, check: bool = True, cache: str | None = None) -> DataFrame:
    """Turns of the files at path; none if there is no such file.

    With a cache folder, parsed turns are kept there under a key of what the files hold, and read
    from there while that is unchanged.
    """
    if not files.found(spark, path):
        return spark.createDataFrame([], SCHEMA)
    raw = split_lines(spark, path)
    if cache is None:
        return parse(raw, check)
    row = spark.read.text(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size", "value").cast("decimal(38,0)")).alias("s")).first()
    return cached(spark, cache, f"{CACHE_VERSION}-{row['n']}-{row['s']}", lambda: parse(raw, check))


def lines(turns: DataFrame) -> DataFrame:
    """(section_idx, line_idx, value): a corpus as lines."""
    turn = F.concat_ws(" ", T.open_tag(F.col("person_id")), F.when(F.col("text") != "", F.col("text")), T.close_tag(F.col("person_id")))
    heads = turns.groupBy("section_idx").agg(F.lit(-1).cast("bigint").alias("line_idx"), F.lit(T.SEC).alias("value"))
    return heads.unionByName(turns.select("section_idx", F.col("turn_idx").cast("bigint").alias("line_idx"), turn.alias("value")))


def write(turns: DataFrame, path: str) -> None:
    """Text files whose parts, in name order, hold the sections in order; they take the place of what was there once all are written."""
    files.publish(turns.sparkSession, path, lambda at: lines(turns).repartitionByRange("section_idx").sortWithinPartitions("section_idx", "line_idx").select("value").write.text(at))


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, the new sections numbered after the old ones."""
    base = old.agg((F.coalesce(F.max("section_idx"), F.lit(-1)) + 1).alias("base"))
    shifted = new.join(F.broadcast(base)).withColumn("section_idx", F.col("section_idx") + F.col("base")).drop("base")
    return old.unionByName(shifted.select(*old.columns))


def fingerprint(turns: DataFrame) -> str:
    """A hash of all turns that depends on their places, made by combinable sums."""
    row = turns.agg(F.sum(F.xxhash64("section_idx", "turn_idx", "person_id", "text").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['n']}:{row['s']}"


def cached(spark: SparkSession, path: str, key: str, build) -> DataFrame:
    """The table at path/key, made by build() if it isn't there: a cache under another key is never read."""
    at = f"{path}/{key}"
    if not files.complete(spark, at):
        files.publish(spark, at, lambda to: build().write.parquet(to))
    return spark.read.parquet(at)
