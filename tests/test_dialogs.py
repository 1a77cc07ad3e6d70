import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.model.network import Network, load, save
from parlance.operators import cleaning, persons, retrieval, sessions, vocabulary
from parlance.sources import corpus, ingest

TURN = "section_idx long, turn_idx long, person_id int, text string"
MSG = "channel string, id long, ts_secs long, author_id long, content string"


def turns(spark, rows):
    return spark.createDataFrame(rows, TURN)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_prefix_cap(spark):
    rows = [(i, 0, 0, f"Here ARE some {i}") for i in range(15)] + [(i, 1, 1, f"here are some {i}") for i in range(15)] + [(20, 0, 0, "ok then")]
    kept = cleaning.cap_prefixes(turns(spark, rows))
    assert kept.where("person_id = 0 and section_idx < 20").count() == 10
    assert kept.where("person_id = 1").count() == 15 and kept.where("section_idx = 20").count() == 1


def test_dedup_cap_ties_and_empty(spark):
    rows = [(i, 0, i % 2, " Same Spam ") for i in range(6)]
    assert rows_of(cleaning.cap_repeats(turns(spark, rows)), "section_idx") == [(0,), (1,), (2,)]
    assert cleaning.clean(turns(spark, [])).count() == 0


def test_repeats_are_ranked_in_one_pass(spark, monkeypatch):
    kept, plans = cleaning.checkpointed, []
    monkeypatch.setattr(cleaning, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    rows = [(i, 0, 1, "Same line") for i in range(5)] + [(9, 0, 1, "other")]
    assert rows_of(cleaning.cap_repeats(turns(spark, rows)), "section_idx") == [(0,), (1,), (2,), (9,)]
    assert len(plans) == 1 and "Join" not in plans[0]


def test_section_rules_and_metrics(spark):
    rows = [(0, 0, 0, "bot only one"), (0, 1, 0, "bot only two"), (1, 0, 1, "user one"), (1, 1, 1, "user two"), (2, 0, 1, "hello there"), (2, 1, 0, "good day to you"), (3, 0, 1, "!!!"), (3, 1, 0, "fine words here")]
    t = turns(spark, rows)
    assert rows_of(cleaning.drop_monologues(t).select("section_idx").distinct(), "section_idx") == [(1,), (2,), (3,)]
    assert rows_of(cleaning.clean(t), "section_idx", "turn_idx") == [(2, 0), (2, 1)]
    m = {r["rule"]: r for r in cleaning.metrics(t).collect()}
    assert m["input"]["turns"] == 8 and m["one_sided"]["turns"] == 4 and m["short_last"]["sections"] == 1


def test_noise_fires_every_rule(spark):
    from parlance.plans import catalog

    m = {r["rule"]: r for r in cleaning.metrics(catalog.noisy(spark, "/root/testdata/sf0.01")).collect()}
    order = [n for n, _ in cleaning.RULES]
    left = [m["input"]["turns"], *[m[n]["turns"] for n in order]]
    for name, before, after in zip(order, left, left[1:], strict=False):
        if name in ("urls", "mentions", "emoji", "markdown", "escapes"):
            assert m[name]["touched"] > 0
        elif name in ("one_sided", "turns", "repeats", "short", "prefixes"):
            assert after < before, name


def test_sections_and_people(spark):
    m = spark.createDataFrame([("c", 1, 0, 100, "hi"), ("c", 2, 10, 200, "yo"), ("c", 3, 1809, 100, "x"), ("c", 4, 3609, 9, "bot"), ("c", 5, 3700, 200, " "), ("c", 6, 3701, 100, "z")], MSG)
    s = sessions.sections(m)
    assert [r["section"] for r in s.orderBy("id").collect()] == [0, 0, 0, 1, 1, 1]
    p = sessions.person_ids(s, F.col("author_id") == 9)
    assert [r["person_id"] for r in p.orderBy("id").collect()] == [1, 2, 1, 0, 1, 2]
    t = sessions.merged_turns(p)
    assert rows_of(t.where("section = 1"), "turn_idx", "person_id", "text") == [(0, 0, "bot"), (1, 2, "z")]
    cut = sessions.sections(m, boundaries=spark.createDataFrame([("c", 2)], "channel string, id long"))
    assert [r["section"] for r in cut.orderBy("id").collect()] == [0, 1, 1, 2, 2, 2]


def test_bot_runs(spark):
    authors = [1, 9, 9, 9, 1, 9, 1]
    m = spark.createDataFrame([("c", i, i, a, "t") for i, a in enumerate(authors)], MSG)
    assert rows_of(sessions.drop_bot_runs(m, F.col("author_id") == 9), "id") == [(0,), (4,), (5,), (6,)]


def test_corpus_round_trip_and_errors(spark, tmp_path):
    t = turns(spark, [(0, 0, 1, "hello there"), (0, 1, 0, "good day"), (1, 0, 2, "third one")])
    corpus.write(t, str(tmp_path / "c"))
    raw = "\n".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert raw.split("\n")[0] == "<SEC>"
    back = corpus.parse(spark.createDataFrame([("f", raw)], "file string, value string"))
    assert rows_of(back, "section_idx", "turn_idx", "person_id", "text") == rows_of(t, "section_idx", "turn_idx", "person_id", "text")
    for bad in ["<PERSON_1> a </PERSON_2>", "<PERSON_1> a", "a </PERSON_1>", "<PERSON_1> <SEC> </PERSON_1>", "<PERSON_1> <PERSON_2> </PERSON_2>"]:
        with pytest.raises(ValueError):
            corpus.parse(spark.createDataFrame([("f", bad)], "file string, value string"))
    assert corpus.read(spark, str(tmp_path / "none")).count() == 0
    assert corpus.append(t, t).agg(F.max("section_idx")).first()[0] == 3


def test_ingest(spark):
    lines = spark.createDataFrame([("c", "7\t2020-01-01T00:00:00Z\t5\tann\t-\thi\\nyou\tmore"), ("c", "x\t1"), ("c", "a\tb\tc\td\te\tf")], "channel string, value string")
    assert [tuple(r) for r in ingest.chat_messages(lines).select("id", "ts_secs", "author_id", "content").collect()] == [(7, 1577836800, 5, "hi\nyou\tmore")]
    d = ingest.dialog_lines(spark.createDataFrame([(0, "a b __eou__ c __eou__"), (1, "only")], "section_idx long, value string"))
    assert rows_of(d, "turn_idx", "person_id", "text") == [(0, 1, "a b"), (1, 0, "c")]
    s = ingest.story_turns(spark.createDataFrame([(0, "One two three. Yes. Four five six seven!"), (1, "Too short.")], "section_idx long, value string"))
    assert rows_of(s, "turn_idx", "text") == [(0, "One two three."), (1, "Four five six seven!")]
    tree = '{"tree_state":"ready_for_export","prompt":{"lang":"en","role":"prompter","text":"a question here","replies":[{"role":"assistant","text":"second best answer","rank":1,"replies":[]},{"role":"assistant","text":"the best answer","rank":0,"replies":[{"role":"prompter","text":"many thanks then","rank":null,"replies":[]}]}]}}'
    t = ingest.tree_turns(spark.createDataFrame([(0, tree), (1, "{bad"), (2, tree.replace('"en"', '"de"'))], "section_idx long, value string"))
    assert rows_of(t, "section_idx", "turn_idx", "person_id", "text") == [(0, 0, 1, "a question here"), (0, 1, 0, "the best answer"), (0, 2, 1, "many thanks then")]
    seeds = ingest.seed_turns(spark.createDataFrame([(0, "hi <b>", "hello")], "section_idx long, user string, bot string"))
    assert rows_of(seeds, "turn_idx", "person_id", "text") == [(0, 1, "hi (b)"), (1, 0, "hello")]
    with pytest.raises(Exception, match="count the rows"):
        ingest.person_rows(spark.createDataFrame([(0, "1\t5\tx")], "nth long, value string")).collect()


def test_vocabulary(spark):
    t = turns(spark, [(0, 0, 0, "b b a"), (0, 1, 2, "a <PERSON_5> c")])
    v = [r["token"] for r in vocabulary.vocabulary(t, 2).orderBy("id").collect()]
    assert v == ["<PAD>", "<UNK>", "<SEC>", "<PERSON_0>", "</PERSON_0>", "<PERSON_1>", "</PERSON_1>", "<PERSON_2>", "</PERSON_2>", "a", "b"]
    assert [r["token"] for r in vocabulary.vocabulary(turns(spark, [])).orderBy("id").collect()] == v[:5]
    assert vocabulary.encode(t, vocabulary.vocabulary(t, 2)).orderBy("turn_idx").first()["ids"] == [10, 10, 9]


def test_persons_and_retrieval(spark):
    bot = persons.ensure_bot(spark.createDataFrame([], "person_id long, user_id long, display_name string"), 9, "bot")
    users = spark.createDataFrame([(5, "eve", 2), (9, "renamed", 1), (4, "ann", 1)], "user_id long, display_name string, first_seen long")
    assert rows_of(persons.assign(bot, users), "person_id", "user_id", "display_name") == [(0, 9, "bot"), (1, 4, "ann"), (2, 5, "eve")]
    with pytest.raises(ValueError):
        persons.ensure_bot(spark.createDataFrame([(0, 1, "x")], "person_id long, user_id long, display_name string"), 9, "bot")
    index = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "row_idx long, embedding array<double>")
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [r["row_idx"] for r in retrieval.top_k(index, q, 2, "row_idx").collect()] == [0, 1]
    assert retrieval.top_k(index, q, 0, "row_idx").count() == 0


def test_network(tmp_path):
    net = Network(12, dim=4, context=3, hidden=8, layers=2)
    windows, targets = np.array([[0, 3, 4], [0, 0, 5], [9, 9, 99]]), np.array([6, 7, 8])
    first = net.loss(windows, np.zeros(3), targets)
    for epoch in range(60):
        net.train_epoch(windows, [0, 0, 0], targets, 0.01, seed=epoch)
    assert net.loss(windows, np.zeros(3), targets) < first / 4
    assert (net.embedding.value[0] == 0).all()
    tokens = [f"t{i}" for i in range(12)]
    save(net, str(tmp_path / "m"), tokens)
    again = load(str(tmp_path / "m"), tokens, 4, 3)
    assert np.allclose(again.forward(windows, [0, 0, 0]), net.forward(windows, [0, 0, 0]))
    assert load(str(tmp_path / "m"), [*tokens, "new"], 4, 3).vocab == 13
    for bad in (tokens[::-1], tokens[:5]):
        with pytest.raises(ValueError):
            load(str(tmp_path / "m"), bad, 4, 3)
    assert load(str(tmp_path / "no"), tokens, 4, 3) is None
    assert net.generate([3, 4], stop=1, forbidden=[0], k=1, most=5) == net.generate([3, 4], stop=1, forbidden=[0], k=1, most=5)


def test_one_step_by_hand():
    """The delta is clipped before it meets the input, and biases decay like weights."""
    net = Network(6, dim=2, context=2, hidden=3, layers=1, seed=1)
    for a in [net.embedding, *net.weights, *net.biases]:
        a.value = a.value.astype(np.float64)
    net.biases[-1].value[:] = 0.5
    acts = net.activations(np.array([2, 3]), 0)
    delta = acts[-1][0] - np.eye(6)[4]
    w, b, clip, lr = net.weights[-1].value.copy(), net.biases[-1].value.copy(), 0.1, 0.01
    net.train_step(np.array([2, 3]), 0, 4, lr, clip)
    g = np.clip(delta, -clip, clip)
    assert (abs(delta) > clip).any()
    for value, old, grad in ((net.biases[-1], b, g), (net.weights[-1], w, g[:, None] * acts[-2])):
        # at the first step the corrected moments are the gradient and its square
        assert np.allclose(value.m, 0.1 * grad) and np.allclose(value.v, 0.001 * grad * grad)
        assert np.allclose(value.value, old - lr * (grad / (abs(grad) + 1e-8) + 1e-4 * old), atol=1e-9)


def test_gradients_are_right():
    net = Network(6, dim=2, context=2, hidden=5, layers=2, seed=3)
    for a in [net.embedding, *net.weights, *net.biases]:
        a.value = a.value.astype(np.float64)
    _, dw, _, _ = net.gradients(np.array([2, 3]), 1, 4)
    w, h = net.weights[0].value, 1e-4
    for i, j in [(0, 0), (3, 2), (4, 4)]:
        w[i, j] += h
        up = net.gradients(np.array([2, 3]), 1, 4)[0]
        w[i, j] -= 2 * h
        down = net.gradients(np.array([2, 3]), 1, 4)[0]
        w[i, j] += h
        assert abs((up - down) / (2 * h) - dw[0][i, j]) < 1e-4


def test_streaming(spark, tmp_path):
    from parlance.streaming import channels

    bodies = [(i, '{"channel_id":"a","channel":"z","input":"m%d"}' % i) for i in range(25)] + [(50, '{"channel_id":"b","input":"fail"}'), (99, '{"input":" "}'), (100, '{"input":"solo"}')]
    spark.createDataFrame(bodies, "seq long, body string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, body string").parquet(str(tmp_path / "in"))
    q = channels.history(channels.requests(stream), lambda text, before: None if text == "fail" else f"{text}:{len(before)}").writeStream.format("memory").queryName("history").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    out = {(r["channel"], r["seq"]): r["entries"] for r in spark.table("history").collect()}
    assert out["a", 0] == ["m0", "m0:0"] and out["a", 24] == [x for i in range(15, 25) for x in (f"m{i}", f"m{i}:{min(2 * i, 20)}")]
    assert out["default", 100] == ["solo", "solo:0"] and out["b", 50] == [] and len(out) == 27
    m = [("c", 1, 0), ("c", 2, 1799), ("c", 3, 3599), ("d", 1, 5)]
    spark.createDataFrame(m, "channel string, id long, ts_secs long").coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("channel string, id long, ts_secs long").parquet(str(tmp_path / "m"))
    q = channels.sections(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["channel"], r["id"], r["section"]) for r in spark.table("live").collect()) == [("c", 1, 0), ("c", 2, 0), ("c", 3, 1), ("d", 1, 0)]
