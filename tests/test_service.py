"""Answers with retrieval, live turns by state, the live index, and blocked nearest neighbours."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import retrieval, sessions
from parlance.streaming import channels, service
from parlance.streaming.turns import PROVIDER, live_turns

TURN = "section_idx long, turn_idx long, person_id int, text string"
REQUEST = "seq long, api_key string, body string"


def test_json_field(spark):
    long = "x\\n\\\\" * 40000 + "\\u00e9"
    cases = {
        '{"input":"hi"}': "hi",
        '{"input" : \n "a\\"b\\\\c\\/d\\n\\r\\t\\u00e9\\u6f22"': 'a"b\\c/d\n\r\té漢',
        'junk "input":"broken json", and more': "broken json",
        '{"x":"no such field"}': None,
        '{"input":5}': None,
        '{"input""x"}': None,
        '{"input":"unfinished': None,
        '{"input":"bad \\x escape"}': None,
        '{"input":"short \\u12"}': None,
        '{"input":"half \\ud83d"}': None,
        '{"input":""}': "",
        '{"input":"é漢😀"}': "é漢😀",
        '{"a":"\\"input\\"","input":"second"}': "second",
        '{"a":{"input":"first"},"input":"second"}': "first",
        '{"input":"tail\\': None,
        '{"input":"' + long + '"}': "x\n\\" * 40000 + "é",
        "": None,
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)] + [(99, None)], "i long, body string")
    got = {r["i"]: r["v"] for r in df.select("i", T.json_field(F.col("body"), "input").alias("v")).collect()}
    for i, (k, v) in enumerate(cases.items()):
        assert got[i] == v, k[:60]
    assert got[99] is None


def nearest(rows, queries, k):
    out = []
    for q, v in queries:
        scored = []
        for place, w in rows:
            if w is None or any(x is None or not np.isfinite(x) for x in w):
                continue
            n = min(len(v), len(w))
            a, b = np.array(v[:n], float), np.array(w[:n], float)
            norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            s = 0.0 if norm == 0 else float(a @ b / norm)
            if np.isfinite(s):
                scored.append((-round(s, 9), place))
        out += [(q, *place, r + 1) for r, (_, place) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    vector = lambda n=4: [float(rng.randrange(-2, 3)) for _ in range(n)]
    rows = [((i // 3, i % 3), vector()) for i in range(150)] + [((99, i), vector()) for i in (2, 0, 1)]
    rows += [((200, 0), None), ((200, 1), [1.0, None, 0.0, 0.0]), ((200, 2), [float("nan")] * 4), ((200, 3), [0.0] * 4), ((200, 4), [float("inf"), 0.0, 0.0, 0.0]), ((201, 0), [1.0, 2.0])]
    queries = [(f"q{i}", vector()) for i in range(12)] + [("zero", [0.0] * 4), ("short", [1.0, 1.0])]
    index = spark.createDataFrame([(*p, v) for p, v in rows], "a long, b long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([*queries, ("none", None)], "query_id string, query array<double>")
    for k in (1, 5, 1000):
        assert sorted(tuple(r) for r in retrieval.top_k_each(index, asked, k, ["a", "b"]).drop("score").collect()) == nearest(rows, queries, k)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 100)
    monkeypatch.setattr(retrieval, "SCORES", 40)
    out = retrieval.top_k_each(index, asked, 5, ["a", "b"])
    assert sorted(tuple(r) for r in out.drop("score").collect()) == nearest(rows, queries, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert retrieval.top_k_each(index, asked, 0, ["a", "b"]).count() == 0
    assert retrieval.top_k_each(index.limit(0), asked, 3, ["a", "b"]).count() == 0 and retrieval.top_k_each(index, asked.limit(0), 3, "a").count() == 0


def test_nearest_rows_are_cut_as_they_come(spark, monkeypatch):
    """What a task holds follows the queries, not the rows of a batch times the queries."""
    rng = np.random.default_rng(3)
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(2000, 4)).round(1))], "a long, embedding array<double>").coalesce(1)
    asked = index.where("a < 20").select(F.col("a").alias("query_id"), F.col("embedding").alias("query"))
    whole = retrieval.top_k_each(index, asked, 5, "a").collect()
    held, best, taken, real = [], retrieval._best, [], type(index).mapInArrow
    monkeypatch.setattr(retrieval, "SCORES", 400)
    monkeypatch.setattr(type(index), "mapInArrow", lambda self, f, schema: taken.append((self, f)) or real(self, f, schema))
    again = retrieval.top_k_each(index, asked, 5, "a").collect()
    key = lambda r: (r["query_id"], r["a"], r["rank"])
    assert sorted(map(key, whole)) == sorted(map(key, again)) and len(whole) == 100
    monkeypatch.setattr(retrieval, "_best", lambda found, *rest: held.append(sum(t.num_rows for t in found)) or best(found, *rest))
    ((rows, run),) = taken
    assert sum(b.num_rows for b in run(iter(rows.toArrow().to_batches()))) == 100
    assert max(held) <= 2 * 400



def indexed(spark, tmp_path):
    turns = spark.createDataFrame([(0, 0, 1, "red apple"), (0, 1, 0, "green pear"), (1, 0, 1, "blue sky"), (1, 1, 0, "red sky"), (2, 0, 1, "?")], TURN)
    words = ["red", "apple", "green", "pear", "blue", "sky"]
    vocab = spark.createDataFrame([(i + 7, w) for i, w in enumerate(words)], "id long, token string")
    vecs = spark.createDataFrame([(i + 7, [float(i == j) for j in range(6)]) for i in range(6)], "id long, vec array<double>")
    path = f"{tmp_path}/index"
    retrieval.put(retrieval.build_index(turns, vocab, vecs, 6), path)
    return path, vocab, vecs


def test_live_index(spark, tmp_path):
    path, vocab, vecs = indexed(spark, tmp_path)
    live = spark.createDataFrame([(50, 0, 1, "green apple"), (50, 1, 0, "")], TURN)
    for _ in range(2):
        retrieval.insert_live(live, vocab, vecs, 6, path, 3)
    index = retrieval.open_index(spark, path)
    assert index.count() == 6 and index.where("batch = 3").count() == 1
    query = F.array(*[F.lit(float(x)) for x in (0, 1, 1, 0, 0, 0)])
    best = retrieval.top_k(index, query, 2, retrieval.INDEX_ORDER).collect()
    assert [(r["batch"], r["section_idx"]) for r in best] == [(3, 50), (-1, 0)]
    assert retrieval.open_index(spark, f"{tmp_path}/none").count() == 0


def answerer(rows):
    """A reply that tells what it was given; none for some inputs."""
    said = F.concat_ws(" | ", "input", F.size("memory").cast("string"), F.element_at("memory", 1))
    return rows.where("input <> 'leave out'").select("channel", "seq", F.when(F.col("input") != "fail", said).alias("reply"))


def test_service(spark, tmp_path):
    path, vocab, vecs = indexed(spark, tmp_path)
    body = lambda text, channel=None: json.dumps({"input": text} | ({"channel_id": channel} if channel else {}))
    batches = [
        [(1, "key", body("red apple", "a")), (2, "key", body("sky", "a")), (3, "no", body("x", "a")), (4, "key", body("  ", "a")), (5, None, body("x")), (6, "key", "no json")],
        [(7, "key", body("fail", "a")), (8, "key", body("unknown words", "b")), (9, "key", body("leave out", "b")), (10, "key", body("pear", "a")), (11, "key", body("blue"))],
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = service.serve(stream, "key", path, vocab, vecs, 6, answerer, f"{tmp_path}/out", live=True)
        q.processAllAvailable()
        q.stop()
        assert q.exception() is None
    out = {r["seq"]: (r["status"], r["body"]) for r in spark.read.parquet(f"{tmp_path}/out/responses").collect()}
    assert out[3] == out[5] == (401, "unauthorized") and out[4] == out[6] == (400, "missing or empty 'input'")
    assert out[7] == out[9] == (503, "generation failed")
    reply = {k: json.loads(v)["reply"] for k, (s, v) in out.items() if s == 200}
    index = retrieval.open_index(spark, path)
    # five recalled turns or all there are, then what the channel said before
    assert reply[1] == "red apple | 5 | <PERSON_1> red apple </PERSON_1>"
    assert reply[2] == "sky | 7 | <PERSON_1> blue sky </PERSON_1>"
    assert reply[8].startswith("unknown words | 5 | ") and reply[11].startswith("blue | 5 | ")
    assert reply[10] == "pear | 9 | <PERSON_0> green pear </PERSON_0>"  # the failed request left no trace
    held = {r["channel"]: r["entries"] for r in service.histories(spark, f"{tmp_path}/out/histories", 99).collect()}
    assert held["a"] == ["red apple", reply[1], "sky", reply[2], "pear", reply[10]] and len(held["b"]) == 2 and len(held["default"]) == 2
    live = index.where("batch >= 0").collect()
    assert {(r["section_idx"], r["person_id"]) for r in live} == {(s, p) for s in (1, 2, 8, 10, 11) for p in (0, 1)}
    types = {r["content_type"] for r in spark.read.parquet(f"{tmp_path}/out/responses").where("status = 200").collect()}
    assert types == {"application/json; charset=utf-8"}


def test_histories_are_bounded_and_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(service, "GATHER", 3)
    path = f"{tmp_path}/h"
    for batch in range(5):
        rows = spark.createDataFrame([("a", batch, f"in{batch}", ["old"]), ("b" if batch else "c", 100 + batch, "x", [])], "channel string, seq long, input string, recalled array<string>")
        out, now = service.replies(rows, service.histories(spark, path, batch), lambda r: r.select("channel", "seq", F.lit("ok").alias("reply")), 4)
        assert out.count() == 2
        service._keep(spark, now, path, batch)
    held = {r["channel"]: r["entries"] for r in service.histories(spark, path, 99).collect()}
    assert held == {"a": ["in3", "ok", "in4", "ok"], "b": ["x", "ok"] * 2, "c": ["x", "ok"]}
    assert sorted(p.name for p in (tmp_path / "h").iterdir()) == ["batch=3", "batch=4"]


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_live_turns_equal_the_batch_query(spark, tmp_path, state_store):
    schema = "channel string, id long, ts_secs long, author_id long, content string"
    rng = random.Random(2)
    rows = []
    for c in "abc":
        t = 1_000_000
        for i in range(70):
            t += rng.choice([1, 20, 100, 1799, 1800, 5000]) if rng.random() < 0.5 else 3
            rows.append((c, i * 3, t, rng.choice([9, 9, 1, 2, 3]), rng.choice(["hi", "you <b> there", " ", "ok https://e.org"])))
    end = max(r[2] for r in rows)
    # batches overlap in time by less than the delay
    rows.sort(key=lambda r: r[2] + rng.randrange(500))
    late = [("a", 10_000, rows[0][2] - 5000, 1, "too late"), ("late only", 1, 5, 1, "much too late")]
    cut = [0, 40, 41, 100, 150, len(rows)]
    batches = [rows[a:b] for a, b in zip(cut, cut[1:], strict=False)] + [late] + [[("z", 1 + n, end + 100_000 * (1 + n), 1, "last")] for n in range(2)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    bot = F.col("author_id") == 9
    out = live_turns(stream, bot, "600 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = out.start()
        q.processAllAvailable()
        q.stop()
        assert q.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out")
    cols = ["channel", "section", "turn_idx", "person_id", "text"]
    told = sorted(tuple(r) for r in got.where("not late and channel <> 'z'").select(*cols).collect())
    whole = sessions.merged_turns(sessions.person_ids(sessions.sections(spark.createDataFrame(rows, schema)), bot))
    want = sorted(tuple(r) for r in whole.select(*[F.col(c).cast("string" if c in ("channel", "text") else "long") for c in cols]).collect())
    assert told == want and len({(r[0], r[1]) for r in want}) > 10
    assert sorted((r["channel"], r["id"]) for r in got.where("late").collect()) == [("a", 10_000), ("late only", 1)]


def test_live_turns_need_their_state_store(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("c").alias("channel"), F.col("value").alias("id"), F.lit(1).cast("long").alias("ts_secs"), F.lit(1).cast("long").alias("author_id"), F.lit("x").alias("content"))
    with pytest.raises(ValueError, match="RocksDB"):
        live_turns(stream, F.lit(False))


def test_chat_logs_what_failed(caplog):
    assert channels.chat(lambda m, t: 1 / 0)("hi", []) is None
    assert "ZeroDivisionError" in caplog.text


class _State:
    """Map, value or list state of a processor, in memory; seen counts the messages read from it."""

    def __init__(self):
        self.held, self.seen = {}, 0

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held.get("value", [])

    def update(self, value):
        self.held["value"] = value

    def appendList(self, rows):
        self.held["value"] = [*self.get(), *rows]

    def appendValue(self, row):
        self.appendList([row])

    def updateValue(self, key, value):
        self.held[key] = value

    def getValue(self, key):
        value = self.held[key]
        self.seen += len(value[0]) if isinstance(value[0], list) else 1
        return value

    def containsKey(self, key):
        return key in self.held

    def removeKey(self, key):
        del self.held[key]

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter([(k, self.getValue(k)) for k in list(self.held)])

    def clear(self):
        self.held.clear()


class _Handle:
    def __init__(self):
        self.states = []

    def getMapState(self, *_):
        self.states.append(_State())
        return self.states[-1]

    getValueState = getListState = getMapState

    def listTimers(self):
        return []

    def registerTimer(self, _):
        pass


class _Timers:
    def __init__(self, passed):
        self.passed = passed

    def getCurrentWatermarkInMs(self):
        return self.passed


def test_live_turns_hold_parts_of_a_channel(monkeypatch):
    """A channel's messages of one batch are merged part by part; turns are given before all have been read."""
    from parlance.streaming import turns as live

    monkeypatch.setattr(live, "PART", 8, raising=False)
    monkeypatch.setattr(live, "GIVEN", 50, raising=False)
    rng = random.Random(4)
    rows = [(i, 10 * i, rng.choice("abc"), False, f"t{i}") for i in range(3000)]
    mixed = rng.sample(rows, len(rows))
    frames = [pd.DataFrame(mixed[i : i + 300], columns=["id", "ts_secs", "author", "bot", "text"]) for i in range(0, 3000, 300)]
    work, handle = live._Turns(1800), _Handle()
    work.init(handle)
    assert list(work.handleInputRows(("c",), iter(frames), _Timers(0))) == []
    waiting, ahead, said = handle.states[0], [], []
    for passed in (10_000_000, 10_000_000, 40_000_000):
        for frame in work.handleExpiredTimer(("c",), _Timers(passed), None):
            said += frame["text"].tolist()
            ahead.append(waiting.seen - sum(len(t.split(" ")) for t in said))
            assert len(frame) <= 51
    turns = [[rows[0][4]]]
    for before, (_, _, author, _, text) in zip(rows, rows[1:]):
        if author == before[2]:
            turns[-1].append(text)
        else:
            turns.append([text])
    assert said == [" ".join(t) for t in turns]
    assert ahead[0] < 300 and not waiting.held


def test_live_turns_ask_the_state_by_parts(monkeypatch):
    """Speakers and texts are known to the task, so calls to the state don't grow with messages; few speakers at a time, and state between drains, change nothing."""
    from parlance.streaming import turns as live

    rng = random.Random(7)
    rows, t = [], 0
    for i in range(4000):
        t += rng.choice([1, 5, 30]) if rng.random() < 0.99 else 1900
        rows.append((i, t, rng.choice("abcdefgh"), i % 11 == 0, rng.choice(["", f"t{i}"])))

    def told(known, cuts, frames):
        monkeypatch.setattr(live, "KNOWN", known, raising=False)
        work, handle = live._Turns(1800), _Handle()
        work.init(handle)
        calls = 0

        def counted(f):
            def call(*args):
                nonlocal calls
                calls += 1
                return f(*args)

            return call

        for state in handle.states:
            for name in ("exists", "get", "update", "appendList", "updateValue", "getValue", "containsKey", "removeKey", "clear"):
                setattr(state, name, counted(getattr(state, name)))
        assert list(work.handleInputRows(("c",), iter([pd.DataFrame(x, columns=["id", "ts_secs", "author", "bot", "text"]) for x in frames]), _Timers(0))) == []
        runs = len({run for run, _ in handle.states[0].keys()})
        out = [tuple(r) for passed in cuts for f in work.handleExpiredTimer(("c",), _Timers(passed), None) for r in f[["section", "turn_idx", "person_id", "text"]].itertuples(index=False)]
        assert not handle.states[0].held
        return out, calls, runs

    end = (t + 5000) * 1000
    frames = [rows[i : i + 500] for i in range(0, 4000, 500)]
    whole, calls, runs = told(10_000, [end], frames)
    assert runs == 1 and calls < 400 and len(whole) > 1000
    assert told(2, [end], frames)[0] == whole
    assert told(10_000, [*range(1000, t * 1000, t * 40), end], frames)[0] == whole
    mixed = rng.sample(rows, len(rows))
    assert told(3, [t * 500, end], [mixed[i : i + 500] for i in range(0, 4000, 500)])[0] == whole


def test_few_pairs_are_scored_exactly(spark, monkeypatch):
    """32-bit products rule out most pairs, and whatever they can't tell about is scored in 64 bits."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(3000, 16))
    rows[5:9] = rows[4] * [[1], [2], [1 + 1e-9], [0]]
    rows[9:13] = [[1e-200] * 16, [1e200] * 16, [np.nan] * 16, [0] * 15 + [np.inf]]
    queries = np.vstack([rows[:40], rows[4:5] * 3 + 1e-9])
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "a long, embedding array<double>").coalesce(2)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id long, query array<double>")
    taken, real = [], type(index).mapInArrow
    monkeypatch.setattr(type(index), "mapInArrow", lambda self, f, schema: taken.append((self, f)) or real(self, f, schema))
    got = sorted((r["query_id"], r["rank"], r["a"]) for r in retrieval.top_k_each(index, asked, 5, "a").collect())
    with np.errstate(all="ignore"):
        norms = np.sqrt((rows * rows).sum(1))[:, None] * np.sqrt((queries * queries).sum(1))[None]
        scores = np.where(norms == 0, 0.0, (rows[:, None] * queries[None]).sum(2) / norms)
    want = []
    for q in range(len(queries)):
        fine = [(-scores[i, q], i) for i in range(len(rows)) if np.isfinite(scores[i, q])]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(sorted(fine)[:5])]
    assert got == sorted(want)
    exact, at_least = [], retrieval._at_least
    monkeypatch.setattr(retrieval, "_at_least", lambda *a: exact.append(at_least(*a)) or exact[-1])
    monkeypatch.setattr(retrieval, "SCORES", 41 * 200)
    ((held, run),) = taken
    list(run(iter(held.toArrow().to_batches())))
    # two of the queries have finite cosines that only 64 bits tell
    assert sum(len(i) for i, *_ in exact) < 2 * len(rows) + 0.05 * len(rows) * len(queries)
