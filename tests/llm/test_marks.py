"""Languages, infilling and periodic runs against brute force, held-out labels and exact round trips."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import entry, infill, language, oracles, periodic
from parlance.session import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, form string, output string, runs string, spans string, score string, held_out string, `a.b` string"


def docs(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, lang, "s", None, 1, "f", "o", "r", "s", "x", "h", "d") for i, t, lang in zip(ids, texts, langs, strict=True)], SCHEMA)


# infilling


def infilled(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if doc_id is None:
        return n, "plain", None, None, text
    x = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abPSM<<>>z .\n\té漢😀\0") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += [None, "", "<", "<P", "<P>", "P>", "<<S>>", "x<M>y", "<PP>", "same", "same", "é" * 50000, "long words and <b> tags " * 40000]
    out = {r["doc_id"]: r for r in infill.transform(docs(spark, texts)).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()}
    forms = set()
    for i, t in enumerate(texts):
        assert tuple(out[i])[1:6] == infilled(i, t) and out[i]["back"] == (t or "")
        forms.add(out[i]["form"])
    assert forms == {"plain", "psm", "spm"}


def test_infill_repeated_and_missing_ids(spark):
    out = infill.digest(infill.transform(docs(spark, ["one two", "one two", "three", "one two"], [7, 7, 7, None]))).collect()
    assert len(out) == 4 and len({tuple(r) for r in out if r["doc_id"] == 7}) == 2
    assert [(r["form"], r["n"], r["prefix_chars"]) for r in out if r["doc_id"] is None] == [("plain", 3, None)]
    assert infill.digest(infill.transform(docs(spark, []))).count() == 0


def test_transitions_by_two_bytes():
    with pytest.raises(ValueError):  # a state that remembers for ever can't be settled by two bytes
        infill.compiled([[0, 1], [1, 1]], [[0, 0], [0, 0]])
    texts = [b"ab", b"", b"P>", b"<", b"P>", b"x<P>"]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    found = infill.transitions(b"".join(texts), starts)
    assert np.flatnonzero(found & infill.SENTINEL).tolist() == [10]  # nothing reaches over the ends of texts
    assert np.flatnonzero(found & infill.UNIT).tolist() == [0, 2, 3, 4, 5, 6, 7, 8, 9, 10]


# runs


def stretches(a, least):
    """All runs, period by period."""
    out, n = set(), len(a)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and a[i] == a[i + q]:
                i += 1
            size = i - s + q
            own = a[s : s + size]
            if size >= max(least, 2 * q) and all(own[x:] != own[:-x] for x in range(1, q)):
                out.add((s, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(rng, count):
    for _ in range(count):
        n, letters = rng.randrange(0, 70), rng.choice([1, 2, 2, 3, 6])
        a = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3) if n > 4 else 0):
            p, s = rng.randrange(1, n // 2), rng.randrange(n)
            for i in range(s + p, min(n, s + rng.randrange(1, 5) * p + rng.randrange(p + 1))):
                a[i] = a[i - p]
        yield a


def test_runs():
    found = 0
    for a in sequences(random.Random(4), 1500):
        for least in (2, 5, 12):
            got = periodic.runs(a, least)
            assert got == stretches(a, least)
            found += len(got)
    assert found > 5000


def test_runs_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(periodic, "DIRECT", 1)
    for a in sequences(random.Random(5), 400):
        assert periodic.runs(a, 2) == stretches(a, 2)
    # with a hash that tells nothing, what is given is still verified word by word
    monkeypatch.setattr(periodic, "MOD", 1)
    for a in sequences(random.Random(6), 200):
        assert set(periodic.runs(a, 2)) <= set(stretches(a, 2))


def test_long_runs():
    assert periodic.runs([1] * 300000) == [(0, 300000, 1)]
    assert periodic.runs([i % 1000 for i in range(100000)]) == [(0, 100000, 1000)]
    x, y = [0], [0, 1]
    while len(y) < 30000:
        x, y = y, y + x
    assert len(periodic.runs(y, 2)) > len(periodic.runs(y)) > 1000


def periodic_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = stretches(words, 12)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    start, size, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(found), start, size, q, None if q is None else 1000 * size // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_periodic_query(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{x}" for x in a) for a in sequences(rng, 200)] + [None, "", " \n\t ", "one", "a b " * 20, "a b " * 20, "é x " * 15, "Aa aA " * 9]
    ids = [*range(len(texts) - 2), 11, None]
    got = sorted(map(tuple, periodic.digest(periodic.find(docs(spark, texts, ids), change=periodic.planted)).collect()), key=str)
    assert got == sorted((periodic_row(i, t) for i, t in zip(ids, texts, strict=True)), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) > 5
    assert periodic.digest(periodic.find(docs(spark, []))).count() == 0


def test_periodic_very_long_text(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**5)}" for _ in range(200000))
    out = periodic.find(docs(spark, [text + " x" * 100000])).first()
    assert [tuple(r) for r in out["runs"]] == [(200000, 100000, 1)] and out["collapsed"] == text + " x"


@pytest.mark.parametrize("name", ["op12_infill", "op13_periodic"])
def test_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    want, got = c.sql(oracles.ORACLES[name]), entry.QUERIES[name](spark, SF)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.select(*cols).fetchall()))


# languages


@pytest.fixture(scope="module")
def learned(spark):
    return language.fit(table(spark, "/root/testdata/sf0.01", "documents"))


def test_language_held_out(spark, learned):
    rows = table(spark, "/root/testdata/sf0.01", "documents")
    out = language.identify(rows, learned).join(rows.select("doc_id", "lang"), "doc_id").where(language.held_out()).collect()
    assert len(out) > 300 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_spans(spark, learned):
    rows = table(spark, "/root/testdata/sf0.01", "documents").where(language.held_out())
    part = {r["lang"]: r["t"] for r in rows.where("length(text) > 600").groupBy("lang").agg(F.min_by(F.substring("text", 1, 300), "doc_id").alias("t")).collect()}
    text = ". ".join(part[x] for x in ("en", "de", "fr", "es"))
    spans = language.identify(docs(spark, [text]), learned).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "fr", "es"]
    at = 0
    for s, lang in zip(spans, ("en", "de", "fr", "es"), strict=True):
        assert abs(s["start"] - at) < 40 and s["letters"] <= s["end"] - s["start"]
        at += len(part[lang]) + 2


def test_language_scripts(spark):
    texts = ["кот и пёс идут домой", "the cat and the dog", "ο σκύλος και η γάτα", "the dog went home"] * 5
    model = language.fit(docs(spark, texts, langs=["ru", "en", "el", None] * 5))
    assert model.names == ["el", "en", "ru"]
    odd = ["γάτα зимой home", "ζ", "жук", "漢字", None, "", "12 !?", "cat " * 200000, "tie", "tie"]
    out = {r["doc_id"]: r for r in language.identify(docs(spark, odd), model).collect()}
    # no switch is dear enough to put a word into a language that isn't written so
    assert [s["lang"] for s in out[0]["spans"]] == ["el", "ru", "en"]
    assert [out[i]["lang_pred"] for i in (1, 2, 4, 5, 6, 7)] == ["el", "ru", "und", "und", "und", "en"]
    assert out[3]["lang_pred"] in model.names and out[3]["score"] == 1 and out[4]["score"] == 0
    assert out[8]["lang_pred"] == out[9]["lang_pred"] and out[7]["score"] == 1
    assert language.identify(docs(spark, []), model).count() == 0


def test_language_without_anything_learned(spark):
    for rows in (docs(spark, []), docs(spark, ["a b", "c"], [None, None]), docs(spark, ["a b"], langs=[None]), docs(spark, [None])):
        model = language.fit(rows)
        assert model.names == []
        assert [tuple(r) for r in language.identify(docs(spark, ["some words"]), model).collect()] == [(0, "und", 0.0, [])]


def test_language_ignores_what_it_may_not_read(spark):
    texts, langs = ["the cat sat", "le chat noir"] * 30, ["en", "fr"] * 30
    own = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    wrong = [lang if i in own else "xx" for i, lang in enumerate(langs)]
    a, b = language.fit(docs(spark, texts, langs=langs)), language.fit(docs(spark, texts, langs=wrong))
    assert a.names == b.names and np.array_equal(a.weights, b.weights)


def test_viterbi():
    rng = np.random.default_rng(9)
    model = language.Languages(["a", "b", "c"], np.zeros((language.SLOTS, 3), np.float32), np.zeros(3, np.int64), 4.0)
    for _ in range(60):
        counts = rng.choice([0, 0, 1, 2, 3, 9, 25], rng.integers(1, 12))
        scores = -rng.exponential(3, (int(counts.sum()), 3))
        labels, at = model.label(scores, counts), 0
        for c in counts.tolist():
            s, path = scores[at : at + c], labels[at : at + c]
            at += c
            if c:
                best = s[0].copy()
                for x in s[1:]:
                    best = np.maximum(best, best.max() - 4) + x
                assert abs(best.max() - (s[np.arange(c), path].sum() - 4 * (np.diff(path) != 0).sum())) < 1e-6
