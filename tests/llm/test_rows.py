"""Repeated rows and ids, ties, nulls and very long texts, through operators and stages."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import licenses, lines, packing, sharding, toxicity
from parlance.llm.entry import vocabulary

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in rows], DOCS)


def unlabelled(rows):
    """The rows under ids that no label has."""
    return [(None if i is None else 10**9 + i, t) for i, t in rows]


def odd(seed=1, words=60000):
    """Rows with repeated ids, repeated texts under one and several ids, nulls, and texts of many words in one and in many lines."""
    rng = random.Random(seed)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b = prose(40), prose(50)
    long = prose(words)
    return [(1, a), (1, a), (1, b), (2, a), (3, None), (3, None), (4, ""), (5, long), (5, long), (6, "\n".join(prose(900) for _ in range(20))), (None, b), (None, None)]


def test_licenses(spark):
    text = licenses.TEMPLATES["MIT notice"]
    out = licenses.scan(docs(spark, [(5, text), (5, text), (6, " ".join(f"x{i}" for i in range(60000)) + "\n" + text), (7, None)])).collect()
    assert sorted((r["doc_id"], r["line"], r["license"]) for r in out) == [(5, 0, "MIT notice"), (5, 0, "MIT notice"), (6, 1, "MIT notice")]
    tied = licenses.scan(docs(spark, [(1, text)]), {"first": text, "second": text}).collect()
    assert [r["license"] for r in tied] == ["first"]
    assert licenses.scan(docs(spark, [])).count() == 0


def test_toxicity(spark):
    model = toxicity.NoisyOr({toxicity._xx("=bad"): 9.0}, -4.0)
    out = toxicity.score(docs(spark, [(1, "A bad thing."), (1, "A bad thing."), (2, "fine " * 200000), (3, None), (3, "")]), model, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["predicted"]) for r in out) == [(1, 1), (1, 1), (2, 0), (3, 0), (3, 0)]
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1


def test_sharding(spark):
    rows = odd()
    out = sharding.digest(sharding.shard(docs(spark, rows), 5)).collect()
    size = lambda t: 16 + len((t or "").encode())
    want = sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    held = {}
    for r in out:
        held.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in held.values())


def test_packing(spark):
    rows = odd(2)
    pieces = packing.digest(packing.pack(docs(spark, rows), vocabulary("word_bpe_49k.json"))).collect()
    by = {}
    for p in pieces:
        by.setdefault((str(p["doc_id"]), p["doc_tokens"]), []).append((p["start"], p["length"]))
    copies = {}
    for (_, tokens), held in by.items():
        n, over = divmod(sum(length for _, length in held), tokens)
        assert over == 0
        copies[tokens] = copies.get(tokens, 0) + n
        # each id of each copy lies in exactly one piece
        seen = [0] * tokens
        for start, length in held:
            for i in range(start, start + length):
                seen[i] += 1
        assert set(seen) == {n}
    assert sum(copies.values()) == len(rows) and copies[1] == 4
    used = {}
    for p in pieces:
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_lines_of_repeated_ids(spark):
    rows = odd(3, 20000)
    out = lines.deduplicate(docs(spark, rows), report=False)
    assert out.columns == docs(spark, rows).columns and out.count() == len(rows)
    held = [(r["doc_id"], r["text"]) for r in out.where("doc_id = 1 or doc_id = 2 or doc_id is null").collect() if r["text"]]
    # each line has one first occurrence; rows that agree in doc_id and text fare alike
    assert {t for _, t in held} == {rows[0][1], rows[2][1]} and len(set(held)) == 2


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = unlabelled(odd(4, 20000))
    out = stage(spark, docs(spark, rows), SF)
    if name == "packing":
        assert {str(r["doc_id"]) for r in out.select("doc_id").distinct().collect()} == {str(i) for i, _ in rows}
        return
    assert out.columns == docs(spark, rows).columns
    left = sorted(str(r["doc_id"]) for r in out.collect())
    if name == "jaccard_join":
        # of linked rows one stays, and rows that agree in doc_id and text are one document, with words or without
        assert left == sorted([*(str(10**9 + i) for i in (1, 3, 4, 5, 6)), "None"])
    else:
        assert left == sorted(str(i) for i, _ in rows)
    assert out.where(F.length("text") > 100000).count() > 0


def spread_of(out, rows):
    """By text that several rows have: over how many shards they lie."""
    text = dict(rows)
    held = {}
    for r in out:
        held.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    return {t: len(s) for t, s in held.items()}


@pytest.mark.parametrize("sizes,more", [([7] * 5 + [1] * 25, 1), ([30] + [1] * 30, 0), ([11, 11, 11, 3, 3, 3] + [1] * 18, 0)])
def test_links_that_shards_cut(spark, sizes, more):
    """A group lies over hardly more shards than its size and the shards' equal counts call for."""
    rows = [(n, f"text {g}") for n, g in enumerate(g for g, size in enumerate(sizes) for _ in range(size))]
    out = sharding.shard(docs(spark, rows), 5).collect()
    counts = {}
    for r in out:
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
    assert set(counts.values()) == {12} and len(out) == 60
    got = spread_of(out, rows)
    for g, size in enumerate(sizes):
        assert got[f"text {g}"] <= -(-size // 12) + more, (g, size)
