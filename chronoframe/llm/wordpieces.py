"""Ids of texts by a byte-pair tokenizers file that drops white space and marks the ends of words, batch by batch.

White space ends every pre-token and is dropped, so the ids of a text are those of its words. Words of ASCII characters
and letters of U+00C0 to U+00FF are cut into pre-tokens by byte classes, and the distinct pre-tokens of a batch are
merged all at once: each round joins, in every pre-token, the leftmost pair of the least rank. All other words (other
scripts, apostrophes, special tokens, control characters) go to the tokenizers library, each distinct one once.

Equal hashes alone never share ids: every pre-token's bytes are compared with those of the one that stands for it.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from .bpe import byte_alphabet
from .common import HashTable, hashes_of, in_parts, unlike

#: Words that a worker remembers at most, of those that the library encodes.
REMEMBERED = 100_000
#: Bytes of text that are encoded at once.
PART = 4 << 20
#: The normalizers and the pre-splitting pattern that the byte classes below stand for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
NONE = np.int32(2**31 - 1)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[0x21:0x7F] = MARK
    out[0x27] = OTHER  # the apostrophe begins endings such as 's
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[list(b" \t\n\v\f\r")] = SPACE
    out[0x80:0xC0] = out[0xC3] = LETTER  # two bytes of U+00C0 to U+00FF; other leading bytes are OTHER
    return out


_CLASS = _classes()


class WordTokenizer:
    """See the module's text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, np.ndarray] = {}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, steps = said["model"], (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        #: Whether the byte classes stand for this file's rules; if not, the library encodes all words.
        self.own = (
            (said.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == (SPLIT, "Removed", True)
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        )
        end = model.get("end_of_word_suffix") or ""
        vocab, chars = model["vocab"], {b: c for c, b in byte_alphabet().items()}
        self.inner, self.last = (np.array([vocab.get(chars[b] + tail, -1) for b in range(256)], np.int32) for tail in ("", end))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.ranks = HashTable(np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64), np.arange(len(merges)))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.own = self.own and bool((self.inner >= 0).all() and (self.last >= 0).all())
        self.special = [t["content"].encode() for t in said.get("added_tokens", [])]
        if any(len(x.split()) != 1 or x.strip() != x for x in self.special):
            raise ValueError("a special token with white space isn't part of one word")

    def _units(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The folded bytes, starts and ends of pre-tokens and of words for the library, and which are the latter."""
        kind = _CLASS[body] if self.own else np.where(_CLASS[body] == SPACE, SPACE, OTHER)
        part = kind != SPACE
        joined = np.empty(len(body), bool)  # with the byte before, in one word
        joined[0] = False
        joined[1:] = part[1:] & part[:-1]
        joined[offsets[:-1][offsets[:-1] < len(body)]] = False
        raw = body.tobytes()
        marked = [m.start() for x in self.special if x in raw for m in re.finditer(re.escape(x), raw)]
        other = np.union1d(np.flatnonzero(kind == OTHER), np.array(marked, np.int64))
        # U+00D7 and U+00F7 are no letters
        signs = np.flatnonzero((body[1:] == 0x97) | (body[1:] == 0xB7)) + 1 if self.own else other[:0]
        other = np.union1d(other, signs[body[signs - 1] == 0xC3]) if len(signs) else other
        cut = part & ~joined
        small = body + ((body - np.uint8(65) < 26) * np.uint8(32))
        high = np.flatnonzero(body == 0xC3)
        high = high[high + 1 < len(body)] + 1
        small[high] += (small[high] < 0x9F) * np.uint8(32)
        begin = np.flatnonzero(cut)
        if len(other):
            word = np.unique(np.searchsorted(begin, other, "right") - 1)
            from_, to = begin[word], np.append(begin[1:], len(body))[word]
            size = to - from_
            inside = np.repeat(from_ - (np.cumsum(size) - size), size) + np.arange(size.sum())
            inside = inside[part[inside]]
            small[inside] = body[inside]
            kind[inside] = OTHER
        change = np.empty(len(body), bool)
        change[0] = True
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        starts = np.flatnonzero(part & (change | ~joined))
        stop = np.ones(len(body), bool)
        stop[:-1] = change[1:] | ~joined[1:]
        ends = np.flatnonzero(part & stop) + 1
        return small, starts, ends, kind[starts] == OTHER

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens."""
        rank = self.ranks(a.astype(np.int64) * self.size + b)
        return np.where(rank < 0, NONE, rank).astype(np.int32)

    def _merge(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans, one after another, and how many each has."""
        size = ends - starts
        count = np.zeros(len(size), np.int64)
        own = np.arange(len(size))
        first = np.cumsum(size) - size
        token = self.inner[body[np.repeat(starts - first, size) + np.arange(size.sum())]]
        token[first + size - 1] = self.last[body[ends - 1]]
        rank = np.full(len(token), NONE, np.int32)
        rank[:-1] = self.pairs(token[:-1], token[1:])
        rank[first + size - 1] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(own):
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            if over.any():
                gone = np.repeat(over, size)
                done.append((own[over], size[over], token[gone]))
                stay = ~gone
                own, size, best = own[~over], size[~over], best[~over]
                token, rank = token[stay], rank[stay]
                first = np.cumsum(size) - size
                if not len(own):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            word = np.searchsorted(first, at, "right") - 1
            lead = np.ones(len(at), bool)
            lead[1:] = word[1:] != word[:-1]
            at = at[lead]  # one a word, the leftmost
            token[at] = self.merged[best]
            ended = at + 2 == first + size
            rank[at] = NONE
            inner = at[~ended]
            rank[inner] = self.pairs(token[inner], token[inner + 2])
            behind = at[at > first]
            rank[behind - 1] = self.pairs(token[behind - 1], token[behind])
            stay = np.ones(len(token), bool)
            stay[at + 1] = False
            token, rank = token[stay], rank[stay]
            size = size - 1
            first = np.cumsum(size) - size
        for who, n, _ in done:
            count[who] = n
        begin = np.cumsum(count) - count
        out = np.empty(count.sum(), np.int32)
        for who, n, ids in done:
            out[np.repeat(begin[who] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        return out, count

    def _library(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by the library, one after another, and how many each has."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 1_000):
            part = new[at : at + 1_000]
            for w, e in zip(part, self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, np.int32)
        parts = [self.known[w] for w in words]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array([len(p) for p in parts], np.int64)

    def encode_all(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids as unsigned 32-bit integers, one row after another, and where rows begin and end.

        Long texts may be cut at white space.
        """
        return in_parts(self._encoded, body, offsets, lambda x: _CLASS[x[1:-1]] == SPACE, PART)

    def _encoded(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(body):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        small, starts, ends, other = self._units(body, offsets)
        hashes = hashes_of(small, starts, ends)
        hashes[other] ^= np.uint64(1)
        _, lead, of = np.unique(hashes, return_index=True, return_inverse=True)
        clash = unlike(small, starts, ends, lead[of])
        if len(clash):  # equal hashes of different bytes: each such unit stands for itself
            of[clash] = len(lead) + np.arange(len(clash))
            lead = np.append(lead, clash)
        plain, odd = np.flatnonzero(~other[lead]), np.flatnonzero(other[lead])
        a, n = self._merge(small, starts[lead[plain]], ends[lead[plain]])
        raw = small.tobytes() if len(odd) else b""
        b, m = self._library([raw[x:y] for x, y in zip(starts[lead[odd]].tolist(), ends[lead[odd]].tolist(), strict=True)])
        flat, count, begin = np.concatenate([a, b]), np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64)
        count[plain], count[odd] = n, m
        begin[plain], begin[odd] = np.cumsum(n) - n, len(a) + np.cumsum(m) - m
        each = count[of]
        upto = np.append(0, np.cumsum(each))
        ids = flat[np.repeat(begin[of] - upto[:-1], each) + np.arange(upto[-1])]
        return ids.astype("<u4"), upto[np.searchsorted(starts, offsets, "left")]


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a public file; built once a worker."""
    return WordTokenizer(path)
