"""Language of documents, and spans of languages within mixed ones.

A text is cut into words of letters. Script ranges narrow which languages a word may be of: those
that are written in the scripts of all its letters. Each candidate has a score for the word, the sum of log
probabilities of its letters after one, two and three others (counted in hashed slots per language,
beginnings and ends of words included). A Viterbi pass over the words, in which a switch of language
costs a penalty, labels spans; all texts of a batch go through it side by side. A document's language
is the one whose spans hold most letters, and its score their share.

Defined results: null text, and text without a letter, is `und` with score 0, as is everything if no
language could be learned; of languages with equally many letters the first by name is given; rows
without doc_id are never learned from nor held out; repeated rows are labelled alike; texts of any
length are labelled whole, in linear time; an empty table gives no row. Only doc_id, text and, to
learn, lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import small_batches, with_ids

FOLDS, FOLD = 3, 1
#: The classifier is fitted on about so many documents of each language, taken by hash, of at most so many languages.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 2000, 256
#: Hashed places of letter sequences.
SLOTS = 1 << 16
#: Cost of a switch of language, in units of log probability.
SWITCH = 16.0
#: Share of a language's letters that a script must hold to be one of its scripts.
SCRIPT_SHARE = 0.005
UNDETERMINED = "und"
#: Words that are scored at once; at this many letters a piece of the batch is cut at the next word.
PIECE = 1 << 19

# First code points of ranges of letters, and the script that each belongs to.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "han"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAB30, "latin"), (0xAB70, "other"),
    (0xAC00, "hangul"), (0xD7FC, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "armenian"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE20, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF65, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({s for _, s in SCRIPTS})
_starts = np.array([s for s, _ in SCRIPTS], np.uint32)
_bits = np.array([1 << NAMES.index(s) for _, s in SCRIPTS], np.int64)

_tables: dict = {}


def _lower() -> np.ndarray:
    """By code point: its lower case if it is a letter, else 0; made once in each worker."""
    if "lower" not in _tables:
        table = np.zeros(0x110000, np.uint32)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                low = c.lower()
                table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
        _tables["lower"] = table
    return _tables["lower"]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == FOLD, F.lit(False))


class Words:
    """Words of many texts: where each begins and ends, and the letters' features."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        #: Where each text begins in the texts laid end to end, each followed by a place that is no letter.
        self.begins = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.x = _lower()[points]
        letter = np.concatenate([[False], self.x > 0]).astype(np.int8)
        edges = np.diff(letter)
        self.starts, self.ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
        #: How many words each text has.
        self.counts = np.diff(np.append(np.searchsorted(self.starts, self.begins), len(self.starts)))

    def pieces(self):
        """(first, last) words of parts with some PIECE places each, or one longer word."""
        at, n = 0, len(self.starts)
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + PIECE)))
            yield at, to
            at = to

    def features(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots (three a place), the first place of each word, and the scripts of each word as bits."""
        a = int(self.starts[first])
        sizes = self.ends[first:last] - self.starts[first:last] + 1  # the place after a word is its end
        heads = np.cumsum(sizes) - sizes
        places = np.repeat(self.starts[first:last] - heads, sizes) + np.arange(int(sizes.sum()))
        x = self.x[places].astype(np.uint64)
        nth = np.arange(len(x)) - np.repeat(heads, sizes)
        before = [np.where(nth >= k, np.concatenate([np.zeros(k, np.uint64), x[:-k]]) if k <= len(x) else 0, 0).astype(np.uint64) for k in (1, 2, 3)]
        slots, h = [], x * np.uint64(0x9E3779B97F4A7C15)
        for k, b in enumerate(before):
            h = (h ^ (b + np.uint64(k + 1))) * np.uint64(0xC2B2AE3D27D4EB4F)
            slots.append(((h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) >> np.uint64(48)).astype(np.int64) % SLOTS)
        bits = _bits[np.searchsorted(_starts, self.x[places], "right") - 1]
        bits[x == 0] = 0
        return np.stack(slots), heads, np.bitwise_or.reduceat(bits, heads) if last > first else np.empty(0, np.int64)


class Languages:
    """Names, log probabilities of slots (slot, language) and scripts, as bits, of each language."""

    def __init__(self, names: list[str], weights: np.ndarray, scripts: np.ndarray, switch: float = SWITCH):
        self.names, self.weights, self.scripts, self.switch = names, weights, scripts, switch

    def word_scores(self, words: Words) -> np.ndarray:
        """(word, language); languages that the scripts rule out have a score that no sum of others reaches."""
        out = np.empty((len(words.starts), len(self.names)), np.float32)
        for first, last in words.pieces():
            slots, heads, scripts = words.features(first, last)
            sums = self.weights[slots[0]]
            sums += self.weights[slots[1]]
            sums += self.weights[slots[2]]
            scores = np.add.reduceat(sums, heads, axis=0)
            whole = (scripts[:, None] & ~self.scripts[None]) == 0
            part = (scripts[:, None] & self.scripts[None]) != 0
            allowed = np.where(whole.any(1)[:, None], whole, np.where(part.any(1)[:, None], part, True))
            # relative to the best, so that sums over long texts stay exact
            scores = np.where(allowed, scores, -np.inf)
            out[first:last] = np.maximum(scores - scores.max(1, keepdims=True), -1e4)
        return out

    def label(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The language of each word on the best path of its text; counts says how many words each text has."""
        out = np.zeros(len(scores), np.int32)
        if not len(scores):
            return out
        order = np.argsort(-counts, kind="stable")
        size = counts[order]
        begin = (np.cumsum(counts) - counts)[order]
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")  # texts that have a word number t
        value = scores[begin[: active[0]]].astype(np.float64)
        came, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int32)
        for t in range(1, len(active)):
            n = active[t]
            at = begin[:n] + t
            value = value[:n] if len(value) > n else value
            top = value.argmax(1)
            moved = value[np.arange(n), top] - self.switch
            best[at] = top
            turn = moved[:, None] > value
            came[at] = turn
            value = np.where(turn, moved[:, None], value) + scores[at]
            value -= value.max(1, keepdims=True)
            if t + 1 == len(active) or active[t + 1] < n:
                rest = active[t + 1] if t + 1 < len(active) else 0
                out[at[rest:]] = value[rest:].argmax(1)
        for t in range(len(active) - 1, 0, -1):
            at = begin[: active[t]] + t
            here = out[at]
            out[at - 1] = np.where(came[at, here], best[at], here)
        if len(active) == 1 or active[0] > active[1]:  # texts of one word
            single = begin[(active[1] if len(active) > 1 else 0) : active[0]]
            out[single] = scores[single].argmax(1)
        return out


def _counted(sample: DataFrame, names: list[str]) -> DataFrame:
    """(language, slot, n) of the sample's letters, the scripts' letters under negative slots."""
    place = {n: i for i, n in enumerate(names)}

    def run(batches):
        for batch in batches:
            by: dict[int, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(place[lang], []).append(text)
            for lang, texts in by.items():
                words = Words(texts)
                total = np.zeros(SLOTS, np.int64)
                for first, last in words.pieces():
                    slots, _, _ = words.features(first, last)
                    total += np.bincount(slots.ravel(), minlength=SLOTS)
                letters = words.x[words.x > 0]
                scripts = np.bincount(np.log2(_bits[np.searchsorted(_starts, letters, "right") - 1]).astype(np.int64), minlength=len(NAMES))
                slot = np.flatnonzero(total)
                script = np.flatnonzero(scripts)
                n = len(slot) + len(script)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, lang, np.int32)), pa.array(np.concatenate([slot, -1 - script]).astype(np.int32)), pa.array(np.concatenate([total[slot], scripts[script]]))], ["language", "slot", "n"])

    return sample.mapInArrow(run, "language int, slot int, n long").groupBy("language", "slot").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = MOST_LANGUAGES) -> Languages:
    """Learned from about per_language documents of each of the `most` commonest languages, outside the held-out fold.

    The driver gets counts of SLOTS slots a language, however many documents there are.
    """
    small_batches(docs.sparkSession)
    known = with_ids(docs, "doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(~held_out())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    sizes = sorted((r["lang"], r["n"]) for r in sizes.collect())  # at most `most` rows
    names = [lang for lang, _ in sizes]
    if not names:
        return Languages([], np.zeros((SLOTS, 0), np.float32), np.zeros(0, np.int64))
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = known.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("text", "lang")
    counts = _counted(sample, names).toArrow()
    language, slot, n = (counts.column(c).to_numpy() for c in ("language", "slot", "n"))
    total, scripts = np.zeros((SLOTS, len(names))), np.zeros((len(names), len(NAMES)))
    letters = slot >= 0
    total[slot[letters], language[letters]] = n[letters]
    scripts[language[~letters], -1 - slot[~letters]] = n[~letters]
    weights = np.log((total + 0.5) / (total.sum(0) + 0.5 * SLOTS))
    held = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(1, keepdims=True), 1)
    return Languages(names, weights.astype(np.float32), (held * (1 << np.arange(len(NAMES)))).sum(1).astype(np.int64))


SPANS = "array<struct<start: bigint, end: bigint, lang: string, letters: bigint>>"


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score and spans (code points, end exclusive) of each document."""
    small_batches(docs.sparkSession)
    names = pa.array([*model.names, UNDETERMINED], pa.string())
    nobody = len(model.names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield _labelled(part.column(0), [t or "" for t in part.column(1).to_pylist()], model, names, nobody)

    rows = with_ids(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, f"doc_id long, lang_pred string, score double, spans {SPANS}")


def _labelled(ids: pa.Array, texts: list[str], model: Languages, names: pa.Array, nobody: int) -> pa.RecordBatch:
    words, n = Words(texts), len(texts)
    if nobody == 0 or not len(words.starts):
        spans = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("letters", pa.int64())])))
        return pa.RecordBatch.from_arrays([ids, pa.array([UNDETERMINED] * n), pa.array(np.zeros(n)), spans], ["doc_id", "lang_pred", "score", "spans"])
    labels = model.label(model.word_scores(words), words.counts)
    owner = np.repeat(np.arange(n), words.counts)
    size = words.ends - words.starts
    held = np.bincount(owner * nobody + labels, size, n * nobody).reshape(n, nobody)
    total = held.sum(1)
    best = held.argmax(1)
    score = held[np.arange(n), best] / np.maximum(total, 1)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(labels) != 0)]))
    last = np.append(first[1:], len(labels)) - 1
    offset = words.begins[owner[first]]
    listed = pa.StructArray.from_arrays(
        [pa.array(words.starts[first] - offset), pa.array(words.ends[last] - offset), names.take(pa.array(labels[first])), pa.array(np.add.reduceat(size, first))], ["start", "end", "lang", "letters"]
    )
    ends = np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, names.take(pa.array(np.where(total > 0, best, nobody))), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), listed)], ["doc_id", "lang_pred", "score", "spans"])
