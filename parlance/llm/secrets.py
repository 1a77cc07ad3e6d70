"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: which trigrams must a text
hold for the rule to match at all. The index has a posting (trigram, text) for every trigram that
some query asks for. Postings are gathered into one bit mask per text and each query is evaluated on
it; only texts that pass are verified with the expression itself. A rule whose query is empty has
no mandatory trigram and is run on every text.

Everything runs as DataFrame functions. Defined results: null text is empty; repeated rows and
equal texts get equal results; matches of kinds that start at one place are listed in the order of the
kinds; texts of any length are scanned whole, and no rule looks further back than a bounded run, so
time grows with the length; an empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Scratch, maybe_broadcast, text_key, with_ids

# The kinds of secrets, their patterns and the least length of what must be that long.
# kind: (pattern, group whose length counts, least length). (?i) concerns ASCII letters only.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
MORE = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,512}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "login": (r"[a-z][a-z0-9+.-]{0,31}://[^\s/:@]+:[^\s/:@]+@[^\s/]+", 0, 0),
}

#: Larger sets of exact strings are cut down to their trigrams, so that queries stay small.
MOST_EXACT = 64

# A query is True (no demand), or a frozenset of frozensets of trigrams: any of the sets must be there whole.


def _and(a, b):
    if a is True or b is True:
        return b if a is True else a
    out = {x | y for x, y in product(a, b)}
    return frozenset(x for x in out if not any(y < x for y in out)) if len(out) <= MOST_EXACT else a


def _or(a, b):
    if a is True or b is True:
        return True
    out = a | b
    return frozenset(x for x in out if not any(y < x for y in out))


def _of_strings(strings) -> object:
    """The query that one of these strings is in the text."""
    out: object = frozenset()
    for s in strings:
        grams = frozenset(s[i : i + 3] for i in range(len(s) - 2))
        out = _or(out, frozenset([grams]) if grams else True)
    return out


class _Known:
    """exact: the lower-cased strings that a part can match, or None; query: what it demands otherwise."""

    def __init__(self, exact, query=True):
        self.exact, self.query = exact, query

    def demand(self):
        return _and(self.query, _of_strings(self.exact)) if self.exact is not None else self.query


def _sequence(parts: list[_Known]) -> _Known:
    exact, query, whole = {""}, True, True
    for p in parts:
        joined = None if p.exact is None else {a + b for a, b in product(exact, p.exact)}
        if joined is None or len(joined) > MOST_EXACT:
            query = _and(_and(query, _of_strings(exact)), p.demand())
            exact, whole = {""}, False
        else:
            query, exact = _and(query, p.query), joined
    return _Known(exact if whole else None, query if whole else _and(query, _of_strings(exact)))


def _analyse(tree) -> _Known:
    parts = []
    for op, arg in tree:
        if op is C.LITERAL:
            parts.append(_Known({chr(arg).lower()}))
        elif op is C.IN:
            chars = set()
            for kind, value in arg:
                if kind is C.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is C.RANGE and value[1] - value[0] < 8:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
                    break
            parts.append(_Known(chars if chars and len(chars) <= 8 else None))
        elif op is C.BRANCH:
            options = [_analyse(x) for x in arg[1]]
            if all(o.exact is not None for o in options):
                parts.append(_Known(set().union(*(o.exact for o in options))))
            else:
                query = options[0].demand()
                for o in options[1:]:
                    query = _or(query, o.demand())
                parts.append(_Known(None, query))
        elif op is C.SUBPATTERN:
            parts.append(_analyse(arg[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = arg
            inner = _analyse(body)
            if (least, most) == (0, 1) and inner.exact is not None:
                parts.append(_Known(inner.exact | {""}))
            elif least == most == 1:
                parts.append(inner)
            else:
                parts.append(_Known(None, inner.demand() if least else True))
        else:
            parts.append(_Known(None))
    return _sequence(parts)


def trigram_query(pattern: str):
    """True, or the sets of lower-case trigrams of which one must be in a matching text (lower-cased)."""
    return _analyse(parser.parse(pattern)).demand()


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """Matched strings, and the strings between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _spans(kind: str, rule: tuple[str, int, int], text: Column) -> Column:
    """array<struct<start, end>> of the rule's matches: gaps and matches alternate, so lengths add up to places."""
    pattern, group, least = rule
    if group == 0 and least and pattern.endswith("+"):
        # one class repeated at the end: runs are maximal, so a least length may be asked for at once
        fixed = len(pattern[: pattern.rindex("[")])
        pattern, least = f"{pattern[:-1]}{{{least - fixed},}}", 0
    hits, gaps = _found(text, pattern)
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if least else hits
    items = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), sized.alias("part"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(F.length(x["part"]) >= least, span).otherwise(F.array().cast("array<struct<start:int,end:int>>"))).alias("out"))

    found = F.aggregate(items, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, key): the index numbers of grams and the texts that hold them; equal texts share a key."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(low.contains(g), F.lit(i)) for i, g in enumerate(grams)]))
    return docs.select(F.col("key"), F.explode(held).alias("gram"))


def scan(docs: DataFrame, base: dict = BASE, more: dict = MORE) -> DataFrame:
    """doc_id and, for each kind, an array of (start, end) in code points."""
    rules = base | more
    queries = {k: trigram_query(r[0]) for k, r in rules.items()}
    grams = sorted({g for q in queries.values() if q is not True for s in q for g in s})
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = with_ids(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key())
    words = (len(grams) + 62) // 63
    masks = [F.bit_or(F.when(F.expr(f"gram div 63 = {w}"), F.expr("shiftleft(1L, gram % 63)")).otherwise(F.lit(0))).alias(f"m{w}") for w in range(words)]
    index = postings(rows, grams).groupBy("key").agg(*masks)

    def holds(gram_set) -> Column:
        out = F.lit(True)
        for w in range(words):
            need = sum(1 << (grams.index(g) % 63) for g in gram_set if grams.index(g) // 63 == w)
            if need:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(need)) == need)
        return out

    passed = {}
    for k, q in queries.items():
        if q is not True:
            passed[k] = F.lit(False)
            for s in q:
                passed[k] = passed[k] | holds(s)
    candidates = scratch.save(index.select("key", *[c.alias(k) for k, c in passed.items()]).where(" or ".join(passed)))
    rows = rows.join(maybe_broadcast(candidates), "key", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select("doc_id", *[(_spans(k, r, F.col("text")) if k not in passed else F.when(F.col(k), _spans(k, r, F.col("text"))).otherwise(none)).alias(k) for k, r in rules.items()])


def spans_text(kinds: list[str]) -> Column:
    """kind:start:end of all kinds by start, then kind as listed, comma-joined."""
    def tagged(nth: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("text")))

    return F.array_join(F.transform(F.sort_array(F.concat(*[tagged(i, k) for i, k in enumerate(kinds)])), lambda s: s["text"]), ",")


def digest(found: DataFrame, base: dict = BASE, more: dict = MORE) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(spans_text([*base]), 256).alias("base_sha256"), spans_text([*base, *more]).alias("spans"))
