"""Token ids of a word-piece BPE file whose merges mark word ends, by a bounded cache.

Almost all words of a corpus are repeats, so ids are looked up by white-space chunk and only unseen
chunks are encoded, in one call for several documents. Texts with characters outside the set for which the word split
below is known to agree with the tokenizer go to the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Bytes that the chunks kept per Python worker may take, by a count of CHUNK_BYTES besides letters and ids.
CACHE_BYTES, CHUNK_BYTES = 32 << 20, 200
#: Texts that are split at once, and their characters; split, a text takes some ten times its size.
PART_TEXTS, PART_CHARS = 64, 1 << 18
_END = "\0"
#: Finds a character outside the set.
_plain = re.compile("[^\t\n\r\x20-\x7e\xa0-įı-ɏ–—‘-”•…€]")
_split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")


def _byte_of_char() -> dict[str, int]:
    """Printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return out


class WordIds:
    def __init__(self, path: str):
        import tiktoken

        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte, ranks = _byte_of_char(), {}
        for token, i in vocab.items():
            body, end = (token[:-4], b"\0") if token.endswith("</w>") and len(token) > 4 else (token, b"")
            if all(c in byte for c in body) and not (token.startswith("<|") and token.endswith("|>")):
                ranks[bytes(byte[c] for c in body) + end] = i
        self.pieces = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        self.last = np.zeros(max(ranks.values()) + 1, bool)
        self.last[[i for b, i in ranks.items() if b.endswith(b"\0")]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _tokenizer(self):
        """The tokenizer itself, which takes some time and memory to load; most texts don't need it."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = True
        return self.whole

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks between white space, across which the tokenizer never joins anything."""
        words = [_split.findall(c) for c in chunks]
        flat = [w for ws in words for w in ws]
        ids = np.array(self.pieces.encode_ordinary(_END.join(flat) + _END), np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(flat):
            raise ValueError("a word's last token has no end mark")
        raw = ids.astype("<u4").tobytes()
        a = 0
        for c, b in zip(chunks, (ends[np.cumsum([len(ws) for ws in words]) - 1] * 4).tolist(), strict=True):
            self.known[c] = raw[a:b]
            self.held += CHUNK_BYTES + len(c) + b - a
            a = b

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as uint32."""
        out: list = [None] * len(texts)
        part: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            if _plain.search(t):
                out[i] = np.array(self._tokenizer().encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            if part and (len(part) == PART_TEXTS or chars + len(t) > PART_CHARS):
                self._look_up(texts, part, out)
                part, chars = [], 0
            part.append(i)
            chars += len(t)
        self._look_up(texts, part, out)
        return out

    def _look_up(self, texts: list[str], part: list[int], out: list) -> None:
        """Puts the ids of the texts of a part, which are split only now, into out."""
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        known, split = self.known, [texts[i].lower().split() for i in part]
        if new := [c for c in set().union(*split) if c not in known]:
            self._learn(new)
        for i, cs in zip(part, split, strict=True):
            out[i] = np.frombuffer(b"".join(map(known.__getitem__, cs)), "<u4")
