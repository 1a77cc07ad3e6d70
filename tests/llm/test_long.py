"""Texts of extreme length and repetition, and plain versions of the window search and of edits."""

import random
import re
import time

import numpy as np
import pytest

from parlance.llm import decontamination, lines, linking, secrets, tokencounts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in zip(ids, texts, strict=True)], DOCS)


def prose(rng, n, words):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


# token counts

MAIL, NUMBER = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+"), re.compile(r"\+?\d[\d ()-]{7,}\d")


def test_edits_are_those_of_plain_expressions():
    rng, n = random.Random(1), 0
    for _ in range(20000):
        t = "".join(rng.choice("ab@@..+- 1(é") for _ in range(rng.randrange(30)))
        found = sorted((m.start(), m.end(), new) for p, new in ((MAIL, "[mail]"), (NUMBER, "[number]")) for m in p.finditer(t))
        out = []
        for x in found:
            if not out or x[0] >= out[-1][1]:
                out.append(x)
        assert tokencounts.redactions(t) == out[::-1]
        n += len(out)
    assert n > 500


def test_edits_of_long_texts_take_linear_time():
    for t in ("a" * 10**6, "a@" * 500000, "@" * 10**6, "a.-" * 300000, "a@b." * 250000, "1 " * 500000):
        begun = time.time()
        tokencounts.redactions(t)
        assert time.time() - begun < 20, t[:4]


def test_all_edits_in_one_pass(ranks):
    enc = tokencounts.encoder(ranks)
    count = lambda s: len(enc.encode_ordinary(s))
    rng, letters = random.Random(2), "ab  \n\t.'s1é,"
    for _ in range(80):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(3000)))
        tree = tokencounts.CountTree(t, count)
        for _ in range(2):  # a second round of edits meets a text that has been edited
            at = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 2 * rng.randrange(25))))
            edits = [(a, b, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 40, 900])))) for a, b in zip(at[::2], at[1::2], strict=False)]
            for a, b, new in reversed(edits):
                t = t[:a] + new + t[b:]
            rng.shuffle(edits)
            tree.edit_all(edits)
            assert tree.text == t and tree.total == count(t) == sum(tree.sums[tree.width :])
    tree = tokencounts.CountTree("word " * 20000, count)
    tree.encoded = 0
    tree.edit_all([(50000, 50004, "other"), (100, 104, "x"), (10**6, 10**7, " end")])
    assert 0 < tree.encoded < 4000 and tree.total == count(tree.text) and tree.text.endswith(" end")


def test_token_counts_of_long_texts(spark, ranks):
    texts = ["a" * 10**6, "mail a@b.c or 123 456 789 0 then more. " * 20000, "same a@b.cd", "same a@b.cd"]
    begun = time.time()
    out = sorted(tuple(r) for r in tokencounts.count_edited(docs(spark, texts, [0, 1, 7, 7]), ranks).collect())
    assert time.time() - begun < 60 and out[1][2] == 40000 and out[2] == out[3] and out[2][2] == 1


# secrets


def test_secrets_of_repeated_beginnings(spark):
    long = "eyJ" + "q" * 20 + "." + "r" * 2000 + "." + "s" * 3000
    texts = ["eyJ" * 100000, long, "eyJ" + "q" * 509 + "." + "r" * 8 + "." + "s" * 8, long, None]
    begun = time.time()
    out = sorted(tuple(r) for r in secrets.digest(secrets.scan(docs(spark, texts, [0, 1, 2, 1, 4]))).select("doc_id", "spans").collect())
    assert time.time() - begun < 60
    assert out == [(0, ""), (1, f"jwt:0:{len(long)}"), (1, f"jwt:0:{len(long)}"), (2, "jwt:0:530"), (4, "")]


# decontamination


def windows_held(items, text):
    """item: (start, similarity) of its best window, from all windows of the lengths of all items."""
    word = re.compile(r"\w+")

    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets = {i: grams(word.findall(t.lower())) for i, t in items if word.findall(t.lower())}
    held = {}
    for s in sets.values():
        for g in s:
            held[g] = held.get(g, 0) + 1
    words, out = word.findall(text.lower()), {}
    whole = {i: sum(1 / held[g] for g in sets[i]) for i in sets}
    for n in {min(len(word.findall(t.lower())), len(words)) for i, t in items if i in sets} if words else ():
        for a in range(len(words) - n + 1):
            own = grams(words[a : a + n])
            for i, s in sets.items():
                share = sum(1 / held[g] for g in s & own) / whole[i]
                if share >= 0.8 - 1e-12 and (i not in out or (-round(share, 9), a) < (-round(out[i][1], 9), out[i][0])):
                    out[i] = (a, share)
    return out


def test_windows_against_all_of_them():
    """Nothing else than a plain search finds, exact passages always, and nearly all that reach the similarity."""
    rng, every, met, exact = random.Random(3), 0, 0, 0
    for _ in range(20):
        kinds = rng.choice([60, 1000, 10**5])
        stem = prose(rng, rng.choice([0, 6, 12]), kinds)
        items = [(i, f"{stem} {prose(rng, rng.choice([2, 4, 5, 9, 20, 38, 59]), kinds)}".strip()) for i in range(8)]
        block = decontamination.Items(items)
        for _ in range(5):
            parts = [prose(rng, rng.randrange(30), kinds)]
            for _ in range(rng.randrange(4)):
                w = rng.choice(items)[1].split()
                for _ in range(rng.randrange(1 + len(w) // 15)):
                    w[rng.choice([0, -1])] = f"z{rng.randrange(9)}"
                parts += [" ".join(w)] * rng.choice([1, 1, 3]) + [prose(rng, rng.randrange(8), kinds)]
            text = " ".join(parts)
            plain = windows_held(items, text)
            found = {block.ids[i]: (a, share) for i, a, _, share in block.leaks(text)}
            assert found.keys() <= plain.keys()
            for i, (a, share) in plain.items():
                every += 1
                if i in found:
                    met += 1
                    assert found[i][1] <= share + 1e-9
                if share > 1 - 1e-9:
                    exact += 1
                    assert abs(found[i][1] - 1) < 1e-9
    assert exact > 50 and every - exact > 15 and met >= 0.97 * every, (exact, every, met)


def test_recall_at_the_edge():
    """Items whose tail is replaced down to the similarity that counts."""
    rng = random.Random(4)
    for n in (15, 25, 38, 59, 100):
        found = 0
        for _ in range(100):
            item = prose(rng, n, 10**6)
            kept = n - int(0.2 * (n - 4))
            text = " ".join([prose(rng, 30, 10**6), *item.split()[:kept], prose(rng, n - kept + 30, 10**6)])
            found += len(decontamination.Items([(1, item)]).leaks(text))
        assert found >= 95, (n, found)


def test_passage_that_many_items_share(spark):
    rng = random.Random(5)
    passage = prose(rng, 30, 10**6)
    items = [(i, f"{passage} {prose(rng, i % 7, 10**6)}".strip()) for i in range(30)]
    block = decontamination.Items(items)
    text = " ".join([passage] * 667)
    begun = time.time()
    out = block.leaks(text)
    assert time.time() - begun < 10 and {block.ids[i] for i, *_ in out} >= {i for i, t in items if t == passage}
    assert all(a < 31 for _, a, _, _ in out)  # of equal windows the first
    rows = sorted(tuple(r) for r in decontamination.find(docs(spark, [text, text, "x"], [3, 3, 4]), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id", "start").collect())
    assert len(rows) == 2 * len(out) and {r[0] for r in rows} == {3}


def test_hashes_of_windows():
    h = np.array(random.Random(6).choices(range(5), k=300), np.uint64)
    sums = decontamination._running(h)
    for n in (1, 2, 7):
        at = np.arange(len(h) - n + 1)
        same = {}
        for a, x in zip(at.tolist(), decontamination._windows(sums, at, n).tolist(), strict=True):
            assert same.setdefault(x, tuple(h[a : a + n])) == tuple(h[a : a + n])
        assert len(same) == len({tuple(h[a : a + n]) for a in at.tolist()})


def test_texts_are_split_part_by_part():
    """Split into words a text takes ten times its size, so a batch is never split as a whole."""
    import tracemalloc

    import public_tokenizers
    from parlance.llm.wordbpe import WordIds

    words, rng = WordIds(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    texts = [prose(rng, 500, 900) for _ in range(800)]
    whole = words.encode(texts)  # all words are known from here on
    tracemalloc.start()
    again = words.encode(texts)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert all(map(np.array_equal, whole, again))
    assert peak - held < 6 << 20


def test_lines_meet_only_lines_of_fitting_length():
    """Rows of a cell that lengths rule out are never paired; those that remain are what a plain search gives."""
    from parlance.llm import lines, linking

    rng = np.random.default_rng(5)
    of = np.sort(rng.integers(0, 30, 900))
    chars = rng.integers(0, 400, 900) * rng.choice([-1, 1], 900)
    role = rng.integers(0, 3, 900)
    size, least = lines._within({"chars": chars})
    asks, there = np.flatnonzero(role > 0), np.flatnonzero(role < 2)
    low, n, order = linking._fitting(of, size, least, asks, there)
    got = {(p, q) for p, a, k in zip(asks.tolist(), low.tolist(), n.tolist(), strict=True) for q in order[a : a + k].tolist()}
    fit = lambda p, q: abs(abs(int(chars[p])) - abs(int(chars[q]))) <= int(0.2 * max(abs(int(chars[p])), abs(int(chars[q]))) + 1e-9)
    assert got == {(p, q) for p in asks.tolist() for q in there.tolist() if of[p] == of[q] and fit(p, q)}
    assert len(got) == n.sum()


def test_words_of_long_lines_are_not_all_kept():
    from parlance.llm import lines

    rng = random.Random(6)
    texts = [prose(rng, 20_000, 900) for _ in range(12)]
    for t in texts:
        assert lines._alike(t, t[:-1])
    assert sum(map(len, lines._words)) <= lines.WORDS_CHARS


def test_edits_of_many_pairs_at_once(monkeypatch):
    """Short lines are compared many at once, with the same outcome as one by one."""
    rng = random.Random(6)
    letters = "abc é日\U0001f600"
    ones, others, most = [], [], []
    for n in [0, 1, 5, 63, 64, 65, 100, 127, 128, 129, 300] * 60:
        a = [rng.choice(letters) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(n // 3 + 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
        ones.append("".join(a)), others.append("".join(b)), most.append(rng.choice([0, 1, n // 5, n]))
    want = [lines.edit_distance(a, b, m) <= m for a, b, m in zip(ones, others, most)]
    single = []
    plain = lines.edit_distance
    monkeypatch.setattr(lines, "edit_distance", lambda a, b, m: single.append(min(len(a), len(b))) or plain(a, b, m))
    assert lines.within_edits(ones, others, most).tolist() == want and 100 < sum(want) < 560
    assert all(n == 0 or n > 64 * lines.COLUMN_WORDS for n in single)


def test_pairs_are_verified_many_at_once():
    """Lines of a bucket are verified together, and what is united already is not verified again."""
    asked = []

    def alike(xs, ys):
        asked.append(len(xs))
        return np.array([x[0] == y[0] for x, y in zip(xs, ys)])

    raw = np.array([f"{'ab'[k % 2]}{k}" for k in range(120)], object)
    col = {"id": np.arange(120), "label": np.arange(120), "raw": raw}
    i, j = np.triu_indices(120, 1)
    links = linking._links(col, i, j, np.zeros(len(i), np.int64), alike, {})
    assert len(links) == 118 and all(raw[m][0] == raw[n][0] for m, n in links)
    assert max(asked) > 100 and sum(asked) < len(i)


def test_edits_of_long_lines_come_in_parts(monkeypatch):
    """Normal forms that wait for their edits to be counted hold a bounded number of characters."""
    rng = random.Random(9)
    ones = [prose(rng, 60, 50) for _ in range(200)]
    others = [x[:40] + "zz" + x[40:] if k % 2 else prose(rng, 60, 50) for k, x in enumerate(ones)]
    whole, waiting, plain = lines._alikes(ones, others), [], lines.within_edits
    monkeypatch.setattr(lines, "WORDS_CHARS", 2000)
    monkeypatch.setattr(lines, "within_edits", lambda a, b, m: waiting.append(sum(map(len, a + b))) or plain(a, b, m))
    assert lines._alikes(ones, others).tolist() == whole.tolist() and whole[1::2].all()
    assert waiting and max(waiting) < 3000
