"""Files read in splits, orders cut into ranges, and channels scanned in ranges of ids, against one-task versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import sessions, vocabulary
from parlance.operators.ordering import cuts, numbered, ranged, running
from parlance.sources import corpus, files, ingest, splits

MSG = "channel string, id long, ts_secs long, author_id long, content string"
TURN = "section_idx long, turn_idx long, person_id int, text string"


@pytest.fixture
def small_splits(spark):
    """Sets the size of splits; the default comes back after the test."""
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def tuples(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# orders


def test_numbered_by_several_columns(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "b", "é", "", None]) or f"t{rng.randrange(200)}", i) for i in range(1500)]
    df = spark.createDataFrame(rows, "n long, token string, id long")
    order = [-F.col("n"), F.col("token"), F.col("id")]
    for ranges in (1, 3, 20):
        got = numbered(df, order, ranges=ranges).orderBy("nth").collect()
        assert [r["nth"] for r in got] == list(range(1500))
        assert [r["id"] for r in got] == [r["id"] for r in df.orderBy(F.expr("-n"), "token", "id").collect()]


def test_ranges_split_ties(spark):
    df = spark.range(4000).select(F.lit(1).alias("n"), F.format_string("t%05d", "id").alias("token"))
    points = cuts(df, [F.col("n"), F.col("token")], 16)
    sizes = [r["count"] for r in ranged(df, ["n", "token"], ranges=16).groupBy("__range").count().collect()]
    assert len(points) == 15 and len(sizes) == 16 and max(sizes) < 4 * 4000 / 16
    assert cuts(df.limit(0), [F.col("n")], 16) == [] and ranged(df, ["n"], ranges=16).select("__range").distinct().count() == 1


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, None])) for i in range(500)]
    out = running(spark.createDataFrame(rows, "a long, v long"), ["a"], F.coalesce("v", F.lit(0)), "s", 9)
    total = 0
    for r in sorted(out.collect()):
        assert r["s"] == total
        total += r["v"] or 0


def test_whole_vocabulary(spark):
    turns = spark.createDataFrame([(i, 0, 1, f"w{i % 700} w{i % 30} zz") for i in range(1400)], TURN)
    rows = vocabulary.vocabulary(turns, 0).orderBy("id").collect()
    out = [r["token"] for r in rows][7:]
    want = [r["token"] for r in vocabulary.token_counts(turns).orderBy(F.desc("n"), "token").collect()]
    assert out == want and len(out) == 701
    assert [r["id"] for r in rows] == list(range(708))


def test_encode_by_join_and_in_place(spark, monkeypatch):
    rows = [(0, 0, 1, "b a <SEC> x"), (0, 1, 0, ""), (0, 2, 0, None), (1, 0, 2, "Ünknown a a")]
    turns = spark.createDataFrame(rows, TURN).repartition(3)
    vocab = spark.createDataFrame([(5, "a"), (6, "b"), (9, "a"), (2, "<SEC>"), (4, "<PERSON_1>")], "id long, token string")
    for unknown in (1, None):
        for tagged in (False, True):
            near = tuples(vocabulary.encode(turns, vocab, unknown, tagged), "section_idx", "turn_idx", "ids")
            with monkeypatch.context() as m:
                m.setattr(vocabulary, "BROADCAST_TOKENS", 1)
                far = tuples(vocabulary.encode(turns, vocab, unknown, tagged), "section_idx", "turn_idx", "ids")
            assert near == far
    assert tuples(vocabulary.encode(turns, vocab), "section_idx", "turn_idx", "ids")[0] == (0, 0, [6, 9, 2, 1])
    plan = vocabulary.encode(turns, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(section_idx" not in plan
    assert vocabulary.encode(turns, vocab.limit(0)).where("section_idx = 1").first()["ids"] == [1, 1, 1]


# files


def test_lines_are_numbered_by_path_and_place(spark, tmp_path, small_splits):
    small_splits(300)
    sizes = {"a": 1, "b": 400, "c": 1, "d": 60}
    want = []
    for name, n in sizes.items():
        lines = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n\n")
        want += [*lines, ""]
    rows = splits.lines(spark, str(tmp_path))
    assert rows.select("file", "block").distinct().count() > 20
    got = splits.numbered_lines(rows).orderBy("line").collect()
    assert [r["line"] for r in got] == list(range(len(want))) and [r["value"] for r in got] == want
    trees = ingest.read_trees(spark, str(tmp_path)).orderBy("section_idx").collect()
    assert [r["value"] for r in trees] == [x for x in want if x]
    first = ingest.read_dialogs(spark, str(tmp_path)).orderBy("section_idx").limit(2).collect()
    assert [r["value"][:8] for r in first] == ["a line 0", ""]


def test_stories_are_numbered_by_path_and_place(spark, tmp_path, small_splits):
    small_splits(200)
    (tmp_path / "1.txt").write_text("Only one here.<|endoftext|>\n")
    (tmp_path / "2.txt").write_text("<|endoftext|>".join(f"Story {i} has words.\nAnd it has more lines. " for i in range(200)))
    (tmp_path / "3.txt").write_text("The last one ends.<|endoftext|> \n <|endoftext|>Or not so soon.")
    out = [r["value"].strip() for r in ingest.read_stories(spark, str(tmp_path)).orderBy("section_idx").collect()]
    assert out == ["Only one here."] + [f"Story {i} has words.\nAnd it has more lines." for i in range(200)] + ["The last one ends.", "Or not so soon."]
    kept = ingest.story_turns(ingest.read_stories(spark, str(tmp_path)), limit=2)
    assert {r["text"] for r in kept.collect()} == {"Story 0 has words.", "And it has more lines.", "Story 1 has words."}


def parsed(texts):
    """Turns and first errors of whole files, token by token."""
    turns, broken, section = [], [], 0
    for name, text in sorted(texts.items()):
        inside, said, n, opened = None, [], 0, None
        for i, token in enumerate(text.split()):
            m = re.fullmatch(r"<(/?)PERSON_\+?(\d{1,18})>", token)
            m = m if m and int(m[2]) < 2**32 else None
            if token == "<SEC>":
                if inside is not None:
                    broken.append((name, i, "section inside a turn"))
                section, n, inside = section + (n > 0), 0, None
            elif m and not m[1]:
                if inside is not None:
                    broken.append((name, i, "turn inside a turn"))
                inside, said, opened = int(m[2]), [], i
            elif m:
                if inside is None:
                    broken.append((name, i, "close without open"))
                else:
                    if inside != int(m[2]):
                        broken.append((name, i, "close of another person"))
                    turns.append((section, n, inside, " ".join(said)))
                    n += 1
                inside = None
            elif inside is not None:
                said.append(token)
        if inside is not None:
            broken.append((name, opened, "turn without end"))
        section += n > 0
    return turns, broken


def corpus_text(rng, n, faults=0):
    out = []
    for _ in range(n):
        if rng.random() < 0.25:
            out.append("<SEC>")
        if rng.random() < 0.1:
            out.append("stray words <PERSON_x> <SEC>x")
        p = rng.choice([0, 1, 2, "+3", 4294967295, 4294967296 if rng.random() < 0.05 else 1])
        words = [rng.choice(["a", "bb", "é ", "<b>", "<PERSON_", "漢字", "x" * rng.randrange(1, 80)]) for _ in range(rng.randrange(0, 8))]
        out += [f"<PERSON_{p}>", *words, f"</PERSON_{str(p).lstrip('+')}>"]
    for _ in range(faults):
        del out[rng.randrange(len(out))]
    return "".join(t + rng.choice([" ", " ", "\n", "\n\n", "\t", "\r\n"]) for t in out)


def test_parse_for_every_size_of_split(spark, tmp_path, small_splits):
    rng = random.Random(3)
    texts = {"a": corpus_text(rng, 3), "b": corpus_text(rng, 120), "c": "", "d": "<SEC> <SEC> no turn", "e": corpus_text(rng, 40), "f": "<PERSON_1> " + "long turn\n" * 300 + "</PERSON_1>"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    turns, broken = parsed(texts)
    assert not broken and turns[-1][0] > 20
    for size in (120, 900, 10**8):
        small_splits(size)
        assert tuples(corpus.read(spark, str(tmp_path)), "section_idx", "turn_idx", "person_id", "text") == turns


def test_errors_for_every_size_of_split(spark, tmp_path, small_splits):
    rng = random.Random(4)
    kinds = set()
    for k in range(6):
        at = tmp_path / str(k)
        at.mkdir()
        texts = {"x": corpus_text(rng, 25, rng.choice([0, 1, 3])), "y": corpus_text(rng, 25, 1)}
        for name, text in texts.items():
            (at / name).write_text(text, newline="")
        turns, broken = parsed(texts)
        small_splits(rng.choice([150, 10**8]))
        raw = splits.lines(spark, str(at))
        got = [(r["file"].rsplit("/", 1)[1], r["pos"], r["error"]) for r in corpus.errors(raw).collect()]
        assert got[:1] == broken[:1] and set(got) <= set(broken)
        kinds |= {b[2] for b in broken[:1]}
        if broken:
            with pytest.raises(ValueError, match=f"{broken[0][2]}: .* at {broken[0][1]} of .*/{broken[0][0]}"):
                corpus.read(spark, str(at))
        assert tuples(corpus.read(spark, str(at), check=False), "section_idx", "turn_idx", "person_id", "text") == sorted(turns)
    assert len(kinds) > 1


def test_white_space_is_that_of_words(spark):
    every = "".join(f"a{chr(c)}b " for c in [*range(9, 14), 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])
    want = spark.createDataFrame([(every,)], "t string").select(T.words(F.col("t"))).first()[0]
    assert corpus._word.findall(every) == want


def test_a_failed_job_leaves_the_old_file(spark, tmp_path):
    path = f"{tmp_path}/v"
    old = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, token string")
    vocabulary.save(old, path)
    assert files.intact(spark, path) and tuples(vocabulary.load(spark, path)) == tuples(old)
    fails = old.withColumn("token", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        vocabulary.save(fails, path)
    assert tuples(vocabulary.load(spark, path)) == tuples(old) and [p.name for p in tmp_path.iterdir()] == ["v"]
    vocabulary.save(old.where("id < 3"), path)
    assert vocabulary.load(spark, path).count() == 3 and files.intact(spark, path)
    (tmp_path / "v").rename(tmp_path / ".v.old")  # a publisher died between its renames
    assert vocabulary.load(spark, path).count() == 3
    next((tmp_path / "v").glob("part-*")).write_text("cut off")
    assert not files.intact(spark, path)


def test_boundary_cache_is_kept_up(spark, tmp_path):
    path = f"{tmp_path}/b"
    m = spark.createDataFrame([(c, i, i, 1, "x") for c in ("001", "a/b c", "d") for i in range(10)], MSG)
    asked = []

    def find(todo):
        asked.append(sorted(r["channel"] for r in todo.select("channel").distinct().collect()))
        return todo.where("id % 4 = 3").select("channel", "id")

    want = [(c, i) for c in ("001", "a/b c", "d") for i in (3, 7)]
    sizes = set()
    for _ in range(4):
        assert tuples(sessions.boundaries_with(m, path, find)) == want
        sizes.add(len(list((tmp_path / "b").rglob("*.parquet"))))
    assert asked == [["001", "a/b c", "d"]] and len(sizes) == 1
    more = m.unionByName(spark.createDataFrame([("d", 11, 11, 1, "x")], MSG))
    for _ in range(2):
        assert tuples(sessions.boundaries_with(more, path, find)) == want + [("d", 11)]
    assert asked[1:] == [["d"]] and len(list((tmp_path / "b").rglob("*.parquet"))) in sizes
    assert sessions.read_boundaries(spark, path).count() == 3


# channels


def random_messages(rng, channels, n):
    rows = []
    for c in channels:
        t, ids = 0, sorted(rng.sample(range(10 * n), n))
        for i in ids:
            t += rng.choice([1, 5, 600, 1799, 1800, 9000]) if rng.random() < 0.3 else 2
            who = 9 if rng.random() < 0.6 else rng.randrange(1, 6)
            rows.append((c, i, None if rng.random() < 0.02 else t, who, rng.choice(["hi", "you there", " ", "<b> https://e.org/x", ""])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("channels", [["one"], ["a", "b", "c", "d"]])
def test_ranges_of_a_channel(spark, channels):
    rng = random.Random(5)
    m = spark.createDataFrame(random_messages(rng, channels, 240 // len(channels)), MSG).repartition(4).cache()
    bot = F.col("author_id") == 9
    extra = m.where("id % 7 = 0").select("channel", "id")

    def steps(rows):
        kept = sessions.drop_bot_runs(rows, bot)
        cut = sessions.sections(kept)
        people = sessions.person_ids(cut, bot)
        return {
            "runs": tuples(kept, "channel", "id"),
            "sections": tuples(cut, "channel", "id", "section"),
            "boundaries": tuples(sessions.sections(kept, boundaries=extra), "channel", "id", "section"),
            "people": tuples(people, "channel", "id", "person_id"),
            "turns": tuples(sessions.merged_turns(people), "channel", "section", "turn_idx", "person_id", "text"),
            "windows": tuples(sessions.sliding_windows(kept), "channel", "window", "position", "id"),
        }

    want = steps(m)
    assert len({r[2] for r in want["sections"]}) > 5 and len(want["runs"]) < 240
    for ranges in (12,) if len(channels) == 1 else (5,):
        got = steps(sessions.spread(m, ranges).cache())
        for name in want:
            assert got[name] == want[name], (name, ranges)
    m.unpersist()


def test_bot_runs_over_many_ranges(spark):
    authors = [9] * 60 + [1] + [9, 9] + [1] + [9] * 90
    m = spark.createDataFrame([("c", i, i, a, "t") for i, a in enumerate(authors)], MSG)
    for ranges in (1, 5, 50):
        out = sessions.drop_bot_runs(sessions.spread(m, ranges), F.col("author_id") == 9)
        assert [r[0] for r in tuples(out, "id")] == [60, 61, 62, 63]


def test_no_window_holds_a_channel(spark):
    m = spark.createDataFrame(random_messages(random.Random(6), ["one"], 200), MSG)
    out = sessions.sections(sessions.drop_bot_runs(sessions.spread(m, 20), F.col("author_id") == 9))
    sizes = [r["count"] for r in out.groupBy("__range").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 60


def test_chat_corpus_is_in_order_of_paths(spark, tmp_path):
    for bucket, name in (("g1", "b"), ("g0", "z"), ("g1", "a")):
        (tmp_path / bucket).mkdir(exist_ok=True)
        lines = [f"{i}\t2020-01-01T0{i}:00:00Z\t{1 + i % 2}\tann\t-\t{name} {i}" for i in range(1, 9)]
        lines = [x.replace(f"T0{i}:", "T01:") if i in (2, 4) else x for i, x in enumerate(lines, 1)]
        (tmp_path / bucket / f"{name}.tsv").write_text("\n".join(lines) + "\nbad line\n")
    (tmp_path / "loose.tsv").write_text("1\t2020-01-01T00:00:00Z\t5\tann\t-\tnot in a bucket\n")
    messages = ingest.read_chat(spark, str(tmp_path))
    assert messages.count() == 24
    out = ingest.chat_corpus(ingest.chat_turns(messages, 2, 3)).orderBy("section_idx", "turn_idx").collect()
    assert [r["section_idx"] for r in out] == sorted(r["section_idx"] for r in out) and {r["section_idx"] for r in out} == set(range(len({r["section_idx"] for r in out})))
    assert [x for i, x in enumerate(r["text"][0] for r in out) if not i or x != out[i - 1]["text"][0]] == ["z", "a", "b"]
