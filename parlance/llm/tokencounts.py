"""Edit-aware token counts.

A document is cut into leaves of whole pre-tokens, and a segment tree holds the sums of their token
counts. A cut before white space that follows another character is always the start of a pre-token
and no look-ahead reaches over it, so leaves can be encoded one by one. An edit touches some leaves;
only these, and the next ones wherever the edit changes the characters at a cut, are encoded again.
Then the sums on the paths to the root are updated.

Defined results: null and empty texts have 0 tokens; edits beyond the end of a text are clipped;
texts of any length are counted whole, and edits are found in linear time; repeated rows are counted
each for itself; an empty table gives no row; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import small_batches, with_ids

LEAF_CHARS = 384
_cut = re.compile(r"(?<=\S)(?=\s)")


def encoder(path: str):
    """A tiktoken encoding from a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def leaves(text: str, least: int = LEAF_CHARS) -> list[str]:
    """text in pieces that start where a pre-token must."""
    out, at = [], 0
    while len(text) - at > least:
        m = _cut.search(text, at + least)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    if at < len(text):
        out.append(text[at:])
    return out


class CountTree:
    """Token counts of one document's leaves under a segment tree of sums."""

    def __init__(self, text: str, count: Callable[[str], int]):
        self.count = count
        self.encoded = 0
        self._build(leaves(text))

    def _tokens(self, piece: str) -> int:
        self.encoded += len(piece)
        return self.count(piece)

    def _build(self, pieces: list[str], counts: list[int] | None = None) -> None:
        self.pieces = pieces
        counts = [self._tokens(p) for p in pieces] if counts is None else counts
        self.width = 1 << max(0, len(pieces) - 1).bit_length()
        self.sums = [0] * self.width + counts + [0] * (self.width - len(counts))
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
        self.starts = [0]
        for p in pieces:
            self.starts.append(self.starts[-1] + len(p))

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def _touched(self, start: int, end: int) -> tuple[int, int]:
        """Leaves from the first whose cut, or the character before it, an edit touches, to the last."""
        a = min(bisect_right(self.starts, start) - 1, len(self.pieces) - 1)
        if a and start <= self.starts[a]:
            a -= 1
        return a, min(bisect_right(self.starts, end), len(self.pieces))

    def edit_all(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces characters (start, end, new) of the text as it is; edits don't overlap.

        Leaves are passed once, however many edits there are; those that edits touch are encoded again, and the sums made anew.
        """
        size = self.starts[-1]
        todo = sorted(((s := min(max(start, 0), size), min(max(end, s), size), new) for start, end, new in edits), key=lambda e: e[:2])
        if not self.pieces:
            self._build(leaves("".join(new for _, _, new in todo)))
            return
        pieces, counts, at, k = [], [], 0, 0
        own = self.sums[self.width : self.width + len(self.pieces)]
        while k < len(todo):
            a, b = self._touched(*todo[k][:2])
            a = max(a, at)
            pieces += self.pieces[at:a]
            counts += own[at:a]
            first = k
            while True:
                while k < len(todo) and self._touched(*todo[k][:2])[0] < b:
                    b = max(b, self._touched(*todo[k][:2])[1])
                    k += 1
                parts, place = [], self.starts[a]
                for start, end, new in todo[first:k]:
                    parts += [self._between(a, place, start), new]
                    place = end
                region = "".join(parts) + self._between(a, place, self.starts[b])
                if b == len(self.pieces) or region and not region[-1].isspace():
                    break
                b += 1  # a cut must follow a character that is no space
            known = dict(zip(self.pieces[a:b], own[a:b], strict=True))
            while pieces and (not region or not region[0].isspace()):  # and be followed by one
                known[pieces[-1]] = counts.pop()
                region = pieces.pop() + region
            cut = leaves(region)
            pieces += cut
            counts += [known[p] if p in known else self._tokens(p) for p in cut]
            at = b
        self._build(pieces + self.pieces[at:], counts + own[at:])

    def _between(self, leaf: int, start: int, end: int) -> str:
        """The text from start to end, start being in that leaf or after it."""
        if start >= end:
            return ""
        leaf = max(leaf, bisect_right(self.starts, start) - 1)
        last = min(bisect_right(self.starts, end - 1), len(self.pieces))
        base = self.starts[leaf]
        return "".join(self.pieces[leaf:last])[start - base : end - base]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end."""
        size = self.starts[-1]
        start, end = min(max(start, 0), size), min(max(end, start, 0), size)
        if not self.pieces:
            self._build(leaves(new))
            return
        a, b = self._touched(start, end)
        base = self.starts[a]
        region = "".join(self.pieces[a:b])
        region = region[: start - base] + new + region[end - base :]
        # context: a cut must still follow a character that is no space
        while a and (not region or not region[0].isspace()):
            a -= 1
            region = self.pieces[a] + region
        while b < len(self.pieces) and (not region or region[-1].isspace()):
            region += self.pieces[b]
            b += 1
        parts = leaves(region)
        if len(parts) == b - a:  # the shape stays: only paths to the root change
            for i, p in zip(range(a, b), parts, strict=True):
                if p != self.pieces[i]:
                    self.pieces[i] = p
                    self._set(i, self._tokens(p))
            for i in range(a, len(self.pieces)):
                self.starts[i + 1] = self.starts[i] + len(self.pieces[i])
            return
        own = dict(zip(self.pieces[a:b], self.sums[self.width + a : self.width + b], strict=True))
        counts = [own[p] if p in own else self._tokens(p) for p in parts]
        old = self.sums[self.width : self.width + len(self.pieces)]
        self._build(self.pieces[:a] + parts + self.pieces[b:], old[:a] + counts + old[b:])

    def _set(self, i: int, value: int) -> None:
        i += self.width
        change = value - self.sums[i]
        while i:
            self.sums[i] += change
            i //= 2


# What mails and long numbers look like; the part of a mail before the @ is looked for backwards, from the @ on.
_domain, _name = re.compile(r"@[\w-]+\.[\w.]+"), re.compile(r"[^\w.+-]")
_number = re.compile(r"\+?\d[\d ()-]{7,}\d")


def _mails(text: str):
    """(start, end) of runs of letters, digits and .+-_ that an @ and a domain follow, each letter looked at twice at most."""
    last = at = 0
    run = 0  # where the run of name characters that reaches the next @ begins
    for m in _domain.finditer(text):
        for x in _name.finditer(text, at, m.start()):
            run = x.end()
        at = m.start()
        if max(run, last) < m.start():
            yield max(run, last), m.end()
            last = m.end()


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The query's edits: (start, end, new) of mails and long numbers, which become placeholders, from the end of the text to its start."""
    found = sorted([(a, b, "[mail]") for a, b in _mails(text)] + [(*m.span(), "[number]") for m in _number.finditer(text)])
    out: list = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out[::-1]


_loaded: dict = {}


def count_edited(docs: DataFrame, ranks: str, edits: Callable[[str], list[tuple[int, int, str]]] = redactions) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after and chars_encoded_again of each document under its edits."""
    small_batches(docs.sparkSession)

    def run(batches):
        enc = _loaded.get(ranks) or _loaded.setdefault(ranks, encoder(ranks))
        count = lambda s: len(enc.encode_ordinary(s))
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                tree = CountTree(t or "", count)
                before, tree.encoded = tree.total, 0
                todo = edits(t or "")
                tree.edit_all(todo)
                out.append((before, len(todo), tree.total, tree.encoded))
            cols = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(c)) for c in cols]], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "chars_encoded_again"])

    rows = with_ids(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, chars_encoded_again long")
