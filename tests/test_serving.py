"""Files, splits, training driver, console, boundaries and chat requests."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.model import training
from parlance.model.network import Network, load
from parlance.operators import cleaning, persons, retrieval, sessions, vocabulary
from parlance.operators.ordering import numbered
from parlance.sources import corpus, ingest
from parlance.streaming import channels

TURN = "section_idx long, turn_idx long, person_id int, text string"


def test_numbered(spark):
    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)] + [(5, 9)] * 4 + [(None, 1)]
    df = spark.createDataFrame(rows, "a long, b long")
    out = numbered(df, ["a", "b"], ranges=16).orderBy("nth").collect()
    assert [r["nth"] for r in out] == list(range(len(rows)))
    assert [(r["a"], r["b"]) for r in out] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert numbered(df.where("a < 0"), ["a", "b"]).count() == 0


def test_vocabulary_file(spark, tmp_path):
    turns = spark.createDataFrame([(0, 0, 1, "b a a"), (0, 1, 0, "c")], TURN)
    assert vocabulary.rebuild(turns, f"{tmp_path}/v") == 3 + 4 + 3
    read = [tuple(r) for r in vocabulary.load(spark, f"{tmp_path}/v").orderBy("id").collect()]
    assert read == [tuple(r) for r in vocabulary.vocabulary(turns).orderBy("id").collect()]


def test_persons_file(spark, tmp_path):
    people = spark.createDataFrame([(1, 7, "a\tb"), (0, 9, "bot")], persons.SCHEMA)
    persons.save(people, f"{tmp_path}/p")
    assert [tuple(r) for r in persons.load(spark, f"{tmp_path}/p").orderBy("person_id").collect()] == [(0, 9, "bot"), (1, 7, "a\tb")]
    assert persons.load(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "bad.tsv").write_text("0\t9\tbot\n2\t4\tx\n")
    with pytest.raises(Exception, match="count the rows"):
        persons.load(spark, f"{tmp_path}/bad.tsv").collect()


def test_corpus_cache(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/1.txt").write_text("<SEC> <PERSON_1> hi </PERSON_1>")
    read = lambda: corpus.read(spark, f"{tmp_path}/c", cache=f"{tmp_path}/k").collect()
    assert read() == read() and len(list((tmp_path / "k").iterdir())) == 1
    (tmp_path / "c/1.txt").write_text("<SEC> <PERSON_1> ho </PERSON_1>")
    assert read()[0]["text"] == "ho" and corpus.read(spark, f"{tmp_path}/x", cache=f"{tmp_path}/k").count() == 0


def test_tree_files(spark, tmp_path):
    with gzip.open(tmp_path / "t.jsonl.gz", "wt") as f:
        f.write('{"a":1}\n\n{"a":2}\n')
    rows = ingest.read_trees(spark, f"{tmp_path}/t.jsonl.gz").orderBy("section_idx").collect()
    assert [r["value"] for r in rows] == ['{"a":1}', '{"a":2}']


def test_splits_and_preludes(spark):
    rows = spark.createDataFrame([(i, 0, ["x"]) for i in range(200)], "section_idx long, turn_idx long, prelude array<string>")
    order = ["section_idx", "turn_idx"]
    split = vocabulary.validation_split(rows, 0.25, order, 200, 10, 20)
    assert sorted(r["section_idx"] for r in split.where("is_val").collect()) == list(range(150, 170))
    assert sorted(r["section_idx"] for r in split.where("not is_val").collect()) == list(range(10))
    assert vocabulary.pretrain_split(rows.limit(1), order, 1).where("is_val").count() == 0
    assert vocabulary.pretrain_split(rows.where("section_idx < 5"), order, 5).where("is_val").count() == 1
    dropped = [{r["section_idx"] for r in vocabulary.drop_preludes(rows, e).where("size(prelude) = 0").collect()} for e in (1, 2, 1)]
    assert dropped[0] == dropped[2] != dropped[1] and 30 < len(dropped[0]) < 90
    assert vocabulary.drop_preludes(rows, 1, 0.0).where("size(prelude) = 0").count() == 0


def test_counters(spark):
    rows = [(0, 0, 0, "bot one"), (0, 1, 0, "bot two"), (1, 0, 1, "user one"), (2, 0, 1, "hello **there**"), (2, 1, 0, "https://e.org/x"), (2, 2, 0, "see https://e.org/x for all of it"), (3, 0, 1, "!!!"), (3, 1, 0, "fine words here")]
    got = {r["counter"]: r["n"] for r in cleaning.counters(spark.createDataFrame(rows, TURN)).collect()}
    want = {"sections_before": 4, "turns_before": 8, "sections_after": 1, "turns_after": 2, "sec_monologue": 1, "sec_single_speaker": 1, "sec_too_short": 1, "turn_url_dominant": 1, "turn_no_alphanum": 1, "url_tokens": 1, "url_turns": 1, "markdown_turns": 1, "markdown_tokens": 2}
    assert {k: got[k] for k in want} == want and not any(v for k, v in got.items() if k not in want)
    assert all(r["n"] == 0 for r in cleaning.counters(spark.createDataFrame([], TURN)).collect())


def test_shuffled_sections(spark):
    rows = [(s, t, t % 2, f"words of {s} and {t}") for s in range(20) for t in range(2)]
    t = spark.createDataFrame(rows, TURN)
    out = [tuple(r) for r in cleaning.clean_shuffled(t).orderBy("section_idx", "turn_idx").select("section_idx", "turn_idx", "text").collect()]
    assert [r[0] for r in out] == [i // 2 for i in range(40)] and sorted(r[2] for r in out) == sorted(r[3] for r in rows) and [r[2] for r in out] != [r[3] for r in rows]


def test_boundaries(spark, tmp_path):
    m = spark.createDataFrame([("c", i, i, 1, "x") for i in range(30)] + [("d", 5, 5, 1, "x")], "channel string, id long, ts_secs long, author_id long, content string")
    answers = spark.createDataFrame([("c", 0, "[0, 4, 19, 20]"), ("c", 1, "[0, 4, 4]"), ("d", 0, "none")], "channel string, window int, answer string")
    found = sessions.window_boundaries(m, answers)
    assert sorted(tuple(r) for r in found.collect()) == [("c", 4), ("c", 19)]
    sessions.keep_boundaries(m, found, f"{tmp_path}/b")
    cache = spark.read.parquet(f"{tmp_path}/b")
    kept, missing = sessions.kept_boundaries(m, cache)
    assert sorted(r["id"] for r in kept.collect()) == [4, 19] and missing.count() == 0
    kept, missing = sessions.kept_boundaries(m.where("id <> 29"), cache)
    assert kept.count() == 0 and [r["channel"] for r in missing.collect()] == ["c"]


def test_index(spark):
    turns = spark.createDataFrame([(0, 0, 1, "a b"), (0, 1, 0, ""), (1, 0, 0, "zzz")], TURN)
    vocab = spark.createDataFrame([(7, "a"), (8, "b")], "id long, token string")
    vecs = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "id long, vec array<double>")
    rows = retrieval.build_index(turns, vocab, vecs, 2).orderBy("section_idx").withColumn("entry", retrieval.rendered(F.col("person_id"), F.col("tokens"))).collect()
    assert [(r["embedding"], r["entry"]) for r in rows] == [([0.5, 0.5], "<PERSON_1> a b </PERSON_1>"), ([0.0, 0.0], "<PERSON_0> zzz </PERSON_0>")]


def test_turn_vectors_need_no_python(spark, monkeypatch):
    turns = spark.createDataFrame([(0, 0, 1, "a b b"), (0, 1, 0, ""), (0, 2, 0, None), (1, 0, 0, "zzz <PAD>")], TURN)
    vocab = spark.createDataFrame([(0, "<PAD>"), (7, "a"), (8, "b"), (6, "b")], "id long, token string")
    vecs = spark.createDataFrame([(7, [3.0, 0.0]), (8, [0.0, 3.0]), (0, [9.0, 9.0])], "id long, vec array<double>")
    want = [(0, 0, [1.0, 2.0]), (0, 1, [0.0, 0.0]), (0, 2, [0.0, 0.0]), (1, 0, [0.0, 0.0])]
    for most in (200_000, 1):
        monkeypatch.setattr(vocabulary, "BROADCAST_TOKENS", most)
        out = retrieval.turn_centroids(turns, vocab, vecs, 2)
        assert sorted((r["section_idx"], r["turn_idx"], r["embedding"]) for r in out.collect()) == want
    for df in (out, retrieval.build_index(turns, vocab, vecs, 2)):
        assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in vocabulary.vocabulary(spark.range(1).selectExpr("id section_idx", "id turn_idx", "1 person_id", "'a' text"))._jdf.queryExecution().executedPlan().toString()


def test_requests(spark):
    rows = spark.createDataFrame([(1, "k", '{"input":" hi ","channel_id":"a"}'), (2, "no", '{"input":"x"}'), (3, None, '{"input":"x"}'), (4, "k", '{"input":" "}')], "seq long, api_key string, body string")
    assert [tuple(r) for r in channels.requests(rows, "k").collect()] == [("a", 1, "hi")]
    assert [tuple(r) for r in channels.statuses(rows, "k").orderBy("seq").collect()] == [(1, 200), (2, 401), (3, 401), (4, 400)]
    answer = channels.chat(lambda memory, text: f"{memory} {text}", lambda text: ["old"])
    assert answer("hi", ["x"]) == "['old', 'x'] hi" and channels.chat(lambda m, t: 1 / 0)("hi", []) is None


def test_training(spark, tmp_path):
    net, tokens = Network(6, 4, 4, 8, 1), list("abcdef")
    steps = spark.createDataFrame([([0, 0, 2, i], 0, 2 + i % 3) for i in range(2, 6)], "window array<long>, step int, label_id long")
    data, profile, path = training.Windows.of(steps), training.Profile(), f"{tmp_path}/m"
    told = list(training.train(net, tokens, lambda epoch: data, data, path, epochs=4, lr=0.02, warmup=2, anneal=4, profile=profile))
    assert [round(e.rate, 6) for e in told] == [round(training.rate(n, 0.02, 1e-5, 2, 4), 6) for n in range(1, 5)]
    assert training.read_best(f"{path}.best-val") == min(e.val_loss for e in told) and load(f"{path}.best", tokens, 4, 4)
    assert profile.steps == 16 and abs(sum(s for s, _ in profile.shares().values()) - 1) < 1e-9
    training.write_best(f"{path}.best-val", -1.0)
    assert not any(e.best for e in training.train(net, tokens, data, data, path, epochs=2))
    assert training.read_best(f"{tmp_path}/none") is None
    empty = training.Windows.of(steps.limit(0))
    assert len(empty) == 0 and not next(training.train(net, tokens, data, empty, epochs=1)).best


def test_learning_console():
    net = Network(8, 4, 4, 8, 1)
    before = [w.value.copy() for w in net.weights]
    assert training.answer_and_learn(net, [3], [5, 1, 6], 4, []) == [5, 1, 6] and net.t == 3
    assert any((a != w.value).any() for a, w in zip(before, net.weights, strict=True))
    steps = net.t
    training.answer_and_learn(net, [3], [], 4, [])
    assert net.t == steps
    saved, seen = [], []

    def reply(line, memory, learning):
        seen.append((line, len(memory), learning))
        return line.upper()

    lines = ["a", "", ":train on", *"bcdef", ":save", ":train off", "g", ":q", "never"]
    assert list(training.converse(lines, reply, lambda: saved.append(1))) == list("ABCDEFG")
    assert seen[1] == ("b", 2, True) and seen[-1] == ("g", 12, False) and len(saved) == 3
    assert np.isclose(training.rate(1, 1.0, 0.1, 0, 0), 1.0)
