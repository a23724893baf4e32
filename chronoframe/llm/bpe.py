"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton accepts exactly the correct tokenizations. It starts as one state with a loop for every byte; each merge
(u, v) -> w, in order, inserts a gadget: arcs labelled u lead to a copy of their target that has lost its arc v, and
wherever an arc u followed by an arc v was, an arc w goes straight to where they led (Berglund, Martens and van der
Merwe, "Constructing a BPE Tokenization DFA", 2024). All arcs with one label lead to one state, and a state is told by
the arcs that it has lost.

Transitions are compiled into one sorted table. Tokens are numbered so that those that began with one token and came
about later than a given merge follow one another; what a state has lost is then a few intervals of numbers, and an arc is
there if an even number of the state's bounds lie before it. The labels of arcs are a trie in a hash table.

Encoding: every prefix of a pre-split word has exactly one correct tokenization, so exactly one arc into each position
comes from a position's state that has it. All distinct words of a batch are taken through the tables at once, position
by position; nothing is tried again. Equal hashes alone never share ids: words' bytes are compared. Decoding emits the
arcs' labels.

Texts are split by byte classes where their words are of ASCII characters and letters of U+00C0 to U+00FF. The distinct
words of a batch with apostrophes or other characters are split by the pattern, all at once, and so are whole texts with
other white space or special tokens; what these are split into goes through the tables like any other word.

Defined results: null and empty texts give no ids and an empty text; special tokens' strings in a text become their ids;
texts of any length are taken whole; repeated rows and ids give repeated results; extra columns are not touched.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashTable, hashes_of, in_parts, map_batches, text_bytes, unlike

#: Fixed value: the public byte-level pre-splitting pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of up to so many bytes go through the tables with others of about their size; from how many longer ones on.
TOGETHER, FEW = (64, 256, 1024), 100
#: Bytes of text that are encoded at once.
PART = 4 << 20
WHITE, LETTER, DIGIT, MARK, OTHER = range(5)
#: Texts that byte classes can't split: with white space beyond ASCII's six characters.
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80".encode("latin-1"))


_MAY_BE_ODD = np.isin(np.arange(256), [*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[0x21:0x7F] = MARK
    out[0x27] = OTHER  # the apostrophe begins endings such as 's
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[list(b" \t\n\v\f\r")] = WHITE
    out[0x80:0xC0] = out[0xC3] = LETTER  # two bytes of U+00C0 to U+00FF; other leading bytes are OTHER
    return out


_CLASS = _classes()


def _distinct(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of distinct words, and which of them each word is; words of one hash are compared byte by byte."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, lead, of = np.unique(hashes_of(body, starts, ends), return_index=True, return_inverse=True)
    clash = unlike(body, starts, ends, lead[of])
    of[clash] = len(lead) + np.arange(len(clash))
    return np.append(lead, clash), of


def _gathered(ids: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids one after another, and where they begin and end."""
    upto = np.append(0, np.cumsum(count))
    return ids[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])], upto


class Automaton:
    """The automaton of a byte-level merge list, with its encoder and decoder."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], special: dict[str, int] | None = None, split: str = SPLIT) -> None:
        byte_of = byte_alphabet()
        self.labels: dict[int, bytes] = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if all(c in byte_of for c in token)}
        self.special = dict(special or {})
        self.labels |= {i: text.encode() for text, i in self.special.items()}
        self.split, self.own_split = regex.compile(split), split == SPLIT
        self.state: dict[int, int] = {i: 0 for token, i in vocab.items() if len(token) == 1 and token in byte_of}
        self._cuts: list[dict[int, int]] = [{}]
        self._left: dict[int, int] = {}
        self._made: dict[int, int] = {}
        self._shared = [len(self.state)]
        for k, (a, b) in enumerate(merges):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self._compile()
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        """Adds merge `k`. `_shared`: for each state, how many labels lead to it."""
        if w in self.state:
            raise ValueError("two merges make one token; the automaton needs one merge a token")
        if u not in self.state or v not in self.state or not self._has(self.state[u], v):
            return  # u v can't stand side by side any more, so no arc w comes about
        from_u, to = self.state[u], self.state[v]
        if self._shared[from_u] == 1 and u != v:
            self._cuts[from_u][v] = k
        else:
            self._cuts.append(self._cuts[from_u] | {v: k})
            self._shared[from_u] -= 1
            self._shared.append(1)
            self.state[u] = len(self._cuts) - 1
        self._left[w], self._made[w], self.state[w] = u, k, to
        self._shared[to] += 1

    def _has(self, state: int, token: int) -> bool:
        """Whether `state` has an arc `token` while the automaton is being built.

        It has lost it if it was cut, or if the token that it began with had been cut by the time it was made.
        """
        cuts, until = self._cuts[state], 1 << 60
        while (at := cuts.get(token)) is None or at > until:
            if token not in self._left:
                return True
            until, token = self._made[token], self._left[token]
        return False

    def _compile(self) -> None:
        """The tables: tokens' numbers, bounds of states' lost intervals, targets, labels and their trie."""
        begun: dict[int, list[int]] = {}
        for w, u in self._left.items():  # in the order of merges
            begun.setdefault(u, []).append(w)
        number, end = {}, {}
        for root in (i for i in self.state if i not in self._left):
            stack = [(root, iter(begun.get(root, ())))]
            number[root] = len(number)
            while stack:
                token, rest = stack[-1]
                if (w := next(rest, None)) is None:
                    end[token] = len(number)
                    stack.pop()
                else:
                    number[w] = len(number)
                    stack.append((w, iter(begun.get(w, ()))))
        made = {u: [self._made[w] for w in ws] for u, ws in begun.items()}
        self._wide = len(number) + 1
        bounds: list[int] = []
        for state, cuts in enumerate(self._cuts):
            lost = [(number[t], number[t] + 1) for t in cuts]
            for t, k in cuts.items():
                if t in begun and (at := bisect_left(made[t], k)) < len(begun[t]):
                    lost.append((number[begun[t][at]], end[t]))
            own: list[int] = []
            for a, b in sorted(lost):
                if own and a <= own[-1]:
                    own[-1] = max(own[-1], b)
                else:
                    own += [a, b]
            bounds += [state * self._wide + x for x in own]
        self._bounds, self._bisected = np.array(bounds, np.int64), array("q", bounds)
        top = max(self.labels, default=-1) + 1
        self._number, self._target = np.zeros(top, np.int64), np.zeros(top, np.int64)
        for t, s in self.state.items():
            self._number[t], self._target[t] = number[t], s
        self._cuts, self._left, self._made, self._shared = [], {}, {}, []
        every = [self.labels.get(i, b"") for i in range(top)]
        self._sizes = np.array([len(x) for x in every], np.int64)
        self._ends = np.append(0, np.cumsum(self._sizes))
        self._bytes = np.frombuffer(b"".join(every), np.uint8)
        nodes: dict[int, int] = {}
        tokens = [-1]
        for t in self.state:
            node = 0
            for byte in self.labels[t]:
                node = nodes.setdefault(node << 8 | byte, len(nodes) + 1)
            tokens += [-1] * (len(nodes) + 1 - len(tokens))
            tokens[node] = t
        self._trie, self._token = nodes, np.array(tokens, np.int32)
        self._child = HashTable(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes)))
        self._longest = max(map(len, map(self.labels.__getitem__, self.state)), default=0)

    def allowed(self, state: int, token: int) -> bool:
        """Whether `state` has an arc `token`."""
        return bisect_right(self._bisected, state * self._wide + int(self._number[token])) % 2 == 0

    def _path(self, word: bytes) -> np.ndarray:
        """Ids of one word: the arcs into each position, from the first to the last."""
        into: list[int] = [-1] * (len(word) + 1)
        for at in range(len(word)):
            state = int(self._target[into[at]]) if at else 0
            node = 0
            for end in range(at, min(len(word), at + self._longest)):
                node = self._trie.get(node << 8 | word[end], -1)
                if node < 0:
                    break
                token = int(self._token[node])
                if token >= 0 and (not at or self.allowed(state, token)):
                    into[end + 1] = token
        out, at = [], len(word)
        while at:
            out.append(into[at])
            at -= int(self._sizes[into[at]])
        return np.array(out[::-1], np.int64)

    def _paths(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of about one size, one after another, and how many each has."""
        size = ends - starts
        first = np.cumsum(size) - size
        own = body[np.repeat(starts - first, size) + np.arange(size.sum())].astype(np.int64)
        left = np.repeat(first + size, size) - np.arange(len(own))
        # tokens that stand at each position, by their number of bytes
        at, node, tokens = np.arange(len(own)), np.zeros(len(own), np.int64), [np.zeros(0, np.int64)]
        while len(at):
            node = self._child(node << 8 | own[at + len(tokens) - 1])
            at, node = at[node >= 0], node[node >= 0]
            if len(at):
                here = np.full(len(own), -1, np.int32)
                here[at] = self._token[node]
                tokens.append(here)
            more = left[at] >= len(tokens)
            at, node = at[more], node[more]
        into = np.full(len(own), -1, np.int32)  # the arc that ends with each byte
        for upto in range(1, int(size.max(initial=0)) + 1):
            open_ = (first + upto - 1)[size >= upto]
            for n in range(min(upto, len(tokens) - 1), 0, -1):
                token = tokens[n][open_ - n + 1]
                there = np.flatnonzero(token >= 0)
                if 1 < n < upto and len(there):  # one byte is left where nothing longer was right
                    key = self._target[into[open_[there] - n]] * self._wide + self._number[token[there]]
                    there = there[np.searchsorted(self._bounds, key, "right") % 2 == 0]
                if len(there):
                    into[open_[there]] = token[there]
                    stay = np.ones(len(open_), bool)
                    stay[there] = False
                    open_ = open_[stay]
                if not len(open_):
                    break
        # back from the ends
        count, rounds = np.zeros(len(size), np.int64), []
        live, last = np.arange(len(size)), first + size - 1
        while len(live):
            token = into[last]
            rounds.append((live, token))
            count[live] += 1
            last -= self._sizes[token]
            more = last >= first[live]
            live, last = live[more], last[more]
        upto = np.cumsum(count)
        out = np.empty(count.sum(), np.int64)
        for k, (live, token) in enumerate(rounds):
            out[upto[live] - 1 - k] = token
        return out, count

    def _words(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all distinct words among these, one after another, and for each word where its own begin and how many they are."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead, of = _distinct(body, starts, ends)
        a, b = starts[lead], ends[lead]
        size = b - a
        ids, count, begin, upto = [], np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64), 0
        for least, most in zip((0, *TOGETHER), (*TOGETHER, 1 << 62), strict=True):
            here = np.flatnonzero((size > least) & (size <= most))
            if not len(here):
                continue
            if most in TOGETHER and (not least or len(here) >= FEW):
                own, n = self._paths(body, a[here], b[here])
            else:
                each = [self._path(body[x:y].tobytes()) for x, y in zip(a[here].tolist(), b[here].tolist(), strict=True)]
                own, n = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            count[here], begin[here] = n, upto + np.cumsum(n) - n
            ids.append(own)
            upto += len(own)
        return np.concatenate(ids), begin[of], count[of]

    def _split(self, text: str, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pattern's words in a text begin and end in its bytes `body`."""
        size = np.fromiter(map(len, self.split.findall(text)), np.int64)
        upto = np.cumsum(size)
        first = upto - size
        if upto[-1:].sum() != len(text):  # a pattern that leaves something out
            first, upto = (np.array(x, np.int64) for x in ([m.start() for m in self.split.finditer(text)], [m.end() for m in self.split.finditer(text)]))
        at = np.append(np.flatnonzero((body & 0xC0) != 0x80), len(body))
        return at[first], at[upto]

    def _split_row(self, row: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a whole row's words begin and end, special tokens apart, and the ids of these (-1: a word)."""
        parts = self.special_split.split(row.decode()) if self.special_split else [row.decode()]
        starts, ends, fixed, at = [], [], [], 0
        for i, part in enumerate(parts):
            own = np.frombuffer(part.encode(), np.uint8)
            a, b = (np.zeros(1, np.int64), np.full(1, len(own))) if i % 2 else self._split(part, own)
            starts.append(at + a)
            ends.append(at + b)
            fixed.append(np.full(len(a), self.special[part] if i % 2 else -1, np.int64))
            at += len(own)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(fixed)

    def _units(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pre-split words, and which of them the pattern has to split further."""
        n = len(body)
        kind = _CLASS[body]
        signs = np.flatnonzero((body[1:] == 0x97) | (body[1:] == 0xB7)) + 1
        kind[signs[body[signs - 1] == 0xC3]] = OTHER  # U+00D7 and U+00F7 are no letters
        begins = np.zeros(n + 1, bool)  # rows
        begins[offsets] = True
        white = kind == WHITE
        edge = np.empty(n, bool)  # of white space, of what isn't, and of rows
        edge[0] = True
        edge[1:] = (white[1:] != white[:-1]) | begins[1:-1]
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], n)
        odd = np.zeros(len(starts), bool)
        odd[np.searchsorted(starts, np.flatnonzero(kind == OTHER), "right") - 1] = True
        kind[np.repeat(odd, ends - starts)] = OTHER
        change = np.empty(n + 1, bool)
        change[0] = change[n] = True
        change[1:n] = (kind[1:] != kind[:-1]) | begins[1:-1]
        # white space before a word: a last space goes with the word, another last character stands alone
        last = ends[white[starts]] - 1
        last = last[~begins[last + 1]]
        change[last] = True
        spaces = last[body[last] == 0x20]
        change[spaces + 1] = False
        starts = np.flatnonzero(change[:n])
        ends = np.append(starts[1:], n)
        return starts, ends, kind[np.minimum(starts + (body[starts] == 0x20), ends - 1)] == OTHER  # a row's last space stands alone

    def encode_all(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids as unsigned 32-bit integers, one row after another, and where rows begin and end.

        Long texts may be cut before a space between two printable ASCII characters: no word reaches over it.
        """
        printable = lambda x: (x > 0x20) & (x < 0x7F)
        return in_parts(self._encoded, body, offsets, lambda x: (x[1:-1] == 0x20) & printable(x[:-2]) & printable(x[2:]), PART)

    def _encoded(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(body):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        raw = body.tobytes()
        # the search is dear, so the bytes that odd white space begins with are looked for first
        some = any(s.encode() in raw for s in self.special) or not self.own_split or (bool(_MAY_BE_ODD[body].any()) and _ODD_SPACE.search(raw) is not None)
        apart = [i for i in range(len(offsets) - 1) if some and offsets[i] < offsets[i + 1] and self._by_pattern(raw[offsets[i] : offsets[i + 1]])]
        starts, ends, odd = self._units(body, offsets)
        if apart:
            stay = ~np.isin(np.searchsorted(offsets, starts, "right") - 1, apart)
            starts, ends, odd = starts[stay], ends[stay], odd[stay]
        lead, of = _distinct(body, starts, ends)
        # words of distinct units: where they stand in the body and what follows it, what they are part of, special ids
        plain, others = np.flatnonzero(~odd[lead]), np.flatnonzero(odd[lead])
        words = [(starts[lead[plain]], ends[lead[plain]], plain, np.full(len(plain), -1, np.int64))]
        more = np.zeros(0, np.uint8)
        if len(others):  # no unit has a line feed, so the pattern makes each of these a word of its own
            joined = b"\n".join([raw[a:b] for a, b in zip(starts[lead[others]].tolist(), ends[lead[others]].tolist(), strict=True)])
            more = np.frombuffer(joined, np.uint8)
            a, b = self._split(joined.decode(), more)
            part = more[a] != 0x0A
            words.append((len(body) + a[part], len(body) + b[part], others[np.cumsum(~part)[part]], np.full(part.sum(), -1, np.int64)))
        for k, i in enumerate(apart):
            a, b, fixed = self._split_row(raw[offsets[i] : offsets[i + 1]])
            words.append((offsets[i] + a, offsets[i] + b, np.full(len(a), len(lead) + k, np.int64), fixed))
        a, b, unit, fixed = (np.concatenate(x) for x in zip(*words, strict=True))
        ordinary = fixed < 0
        ids, begin, count = np.zeros(0, np.int64), np.zeros(len(a), np.int64), np.ones(len(a), np.int64)
        ids, begin[ordinary], count[ordinary] = self._words(np.concatenate([body, more]), a[ordinary], b[ordinary])
        begin[~ordinary] = len(ids) + np.arange((~ordinary).sum())
        ids, each = _gathered(np.concatenate([ids, fixed[~ordinary]]).astype("<u4"), begin, count)
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        begin, count = np.zeros(len(lead) + len(apart), np.int64), np.bincount(unit, count, len(lead) + len(apart)).astype(np.int64)
        begin[unit[first]] = each[first]
        starts, of = np.append(starts, offsets[apart]), np.append(of, len(lead) + np.arange(len(apart)))
        order = np.argsort(starts, kind="stable")
        ids, upto = _gathered(ids, begin[of[order]], count[of[order]])
        return ids, upto[np.searchsorted(starts[order], offsets, "left")]

    def _by_pattern(self, row: bytes) -> bool:
        return not self.own_split or _ODD_SPACE.search(row) is not None or any(s.encode() in row for s in self.special)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(*text_bytes(pa.array([text], pa.string())))[0].tolist()

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Labels of all rows' arcs, one after another, and where rows begin and end."""
        size = self._sizes[ids]
        upto = np.append(0, np.cumsum(size))
        return self._bytes[np.repeat(self._ends[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes(), upto[at]

    def decode(self, ids: Iterable[int]) -> str:
        """Labels of arcs, joined; bytes that aren't UTF-8 become U+FFFD."""
        own = np.array(list(ids), np.int64)
        return self.decode_all(own, np.array([0, len(own)]))[0].decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def from_file(path: str) -> Automaton:
    """The automaton of a public tokenizer's JSON file; built once a worker."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model = said["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in said.get("added_tokens", [])})


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = from_file(vocabulary)
        ids, at = automaton.encode_all(*text_bytes(batch.column(1)))
        raw, ends = automaton.decode_all(ids, at)
        decoded = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), f, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, without sending ids back to the JVM."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = from_file(vocabulary)
        ids, at = automaton.encode_all(*text_bytes(batch.column(1)))
        raw, ends = automaton.decode_all(ids, at)
        codes, text_sha = memoryview(ids.tobytes()), []
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            own = raw[a:b]
            try:
                own.decode("utf-8")
            except UnicodeDecodeError:
                own = own.decode("utf-8", "replace").encode()
            text_sha.append(hashlib.sha256(own).hexdigest())
        ids_sha = [hashlib.sha256(codes[4 * a : 4 * b]).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), f, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
