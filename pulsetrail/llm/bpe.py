"""The public word-level BPE vocabulary: pieces of text, exact merging, and a transducer of frequent words.

``MergeTable`` holds the vocabulary file's merges. A word is merged exactly as the format says:
again and again the adjacent pair of lowest rank, the leftmost of equals. Short words are merged
together in numpy, one merge a word and step; long ones with a heap, in n log n.

``Lexicon`` is a minimal acyclic transducer: the frequent words share prefixes and suffixes in one
automaton whose edges carry how many accepted words they skip, so that a word's number, and with it
its ids, is the sum along its path. It lies in one file that tasks map into memory.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: fixed values: the word pattern of the vocabulary's pre-tokeniser, and the byte letters of byte-level BPE
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LONG = 48
#: slots of the table of pairs: at most a fifth are taken
SLOT_BITS = 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free letter from 256."""
    rest = [b for b in range(256) if b not in PRINTABLE]
    of = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [of[b] for b in range(256)]


class MergeTable:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.final = np.array([vocab[x + end] for x in letters], dtype=np.int64)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.none = len(keys)
        # pairs by open addressing: a pair lies at its hash's slot or in the next free one
        self.slots, self.rank = np.full((1 << SLOT_BITS) + len(keys), -1, np.int64), np.full((1 << SLOT_BITS) + len(keys), self.none, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.slots[at[left]] < 0)
            _, one = np.unique(at[left[free]], return_index=True)
            put = left[free[one]]
            self.slots[at[put]], self.rank[at[put]] = keys[put], put
            left = np.setdiff1d(left, put)
            at[left] += self.slots[at[left]] >= 0
        self.made_by_rank = made.astype(np.int32)
        both = np.concatenate([self.inner, self.final])
        # ranks of two bytes inside a word, and of its last two (512 columns)
        self.first_ranks = self.ranks(np.repeat(self.inner, 512), np.tile(both, 256)).reshape(256, 512)
        self.pattern = regex.compile("\n|" + WORD_PATTERN)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right
        at = self._slot(key)
        found = self.slots[at]
        out = np.where(found == key, self.rank[at], self.none)
        more = np.flatnonzero((found != key) & (found >= 0))
        while len(more):
            at[more] += 1
            found = self.slots[at[more]]
            hit = found == key[more]
            out[more[hit]] = self.rank[at[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words: all ids in order, and where each word's begin (one more at the end)."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in ((1, 4), (5, 8), (9, 12), (13, 20), (21, LONG)):
            at = np.flatnonzero((lengths >= lo) & (lengths <= hi))
            for part in np.array_split(at, len(at) * hi // 400_000 + 1) if len(at) else ():
                symbols, n = self._merge_short([words[i] for i in part], lengths[part], hi)
                counts[part] = n
                found.append((part, symbols, n))
        long = {i: self._merge_long(words[i]) for i in np.flatnonzero(lengths > LONG)}
        for i, ids in long.items():
            counts[i] = len(ids)
        begin = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(begin[-1], np.int64)
        for part, symbols, n in found:
            col = np.arange(symbols.shape[1])
            keep = col < n[:, None]
            out[(begin[part][:, None] + col)[keep]] = symbols[keep]
        for i, ids in long.items():
            out[begin[i]:begin[i + 1]] = ids
        return out, begin

    def _merge_short(self, words: list[bytes], n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A row of symbols a word, and how many; worked on with a column a word, so that each step runs along memory."""
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).T
        n, rows, letter = n.astype(np.int32), np.arange(len(words)), raw.astype(np.int32)
        letter[n - 1, rows] += 256
        symbols = np.concatenate([self.inner, self.final]).astype(np.int32)[letter]
        ranks = np.full((width, len(words)), self.none, np.int32)
        if width > 1:
            ranks[:-1] = self.first_ranks[raw[:-1], letter[1:]]
        ranks[np.arange(width)[:, None] >= n - 1] = self.none
        done_symbols, done_n, live = np.zeros((len(words), width), np.int32), np.zeros(len(words), np.int64), rows
        while len(live):
            best, at = ranks[0].copy(), np.zeros(len(live), np.int32)
            for k in range(1, len(ranks)):
                less = ranks[k] < best
                np.copyto(best, ranks[k], where=less)
                at[less] = k
            stop = best == self.none
            if stop.any():
                done_symbols[live[stop], :len(symbols)], done_n[live[stop]] = symbols[:, stop].T, n[stop]
                go = np.flatnonzero(~stop)
                live, n, at, best = live[go], n[go], at[go], best[go]
                if not len(live):
                    break
                most = int(n.max())
                symbols, ranks = symbols[:most, go], ranks[:most, go]
            i = np.arange(len(live))
            for k in range(len(symbols) - 1):
                move = at < k
                np.copyto(symbols[k], symbols[k + 1], where=move)
                np.copyto(ranks[k], ranks[k + 1], where=at <= k)
            symbols[at, i] = made = self.made_by_rank[best]
            n -= 1
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < n)
            ranks[at, i] = self.none
            ranks[at[left] - 1, left] = self.ranks(symbols[at[left] - 1, left], made[left])
            ranks[at[right], right] = self.ranks(made[right], symbols[at[right] + 1, right])
            ranks[n - 1, i] = self.none
        return done_symbols, done_n

    def _merge_long(self, word: bytes) -> np.ndarray:
        s = self.inner[np.frombuffer(word, np.uint8)].tolist()
        s[-1] = int(self.final[word[-1]])
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        first = self.ranks(np.array(s[:-1]), np.array(s[1:]))
        heap = [(int(r), i) for i, r in enumerate(first) if r < self.none]
        heapq.heapify(heap)
        cache: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in cache:
                cache[a, b] = int(self.ranks(np.array([a]), np.array([b]))[0])
            return cache[a, b]

        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if s[i] >= 0 else len(s)
            if j >= len(s) or rank(s[i], s[j]) != r:
                continue
            s[i], s[j] = int(self.made_by_rank[r]), -1
            after[i] = after[j]
            if after[j] < len(s):
                before[after[j]] = i
                if (x := rank(s[i], s[after[j]])) < self.none:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank(s[before[i]], s[i])) < self.none:
                heapq.heappush(heap, (x, before[i]))
        return np.array([x for x in s if x >= 0], np.int64)

    def pieces(self, chunks: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The pre-tokeniser's pieces of chunks without white space of ASCII, and where each chunk's begin."""
        text = b"\n".join(chunks).decode("utf-8", "replace")
        if any(x in text for x in self.special):
            # special strings are found in the text as it is, before anything is lower-cased
            found = []
            for part in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text):
                found += [part] if part in self.special else self.pattern.findall(self._plain(part))
        else:
            found = self.pattern.findall(self._plain(text))
        breaks = np.flatnonzero(np.fromiter((x == "\n" for x in found), bool, len(found)))
        begin = np.concatenate([[0], breaks - np.arange(len(breaks)), [len(found) - len(breaks)]])
        return [x for x in found if x != "\n"], begin

    @staticmethod
    def _plain(text: str) -> str:
        # letter by letter: a final sigma is no special case
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class Lexicon:
    """A minimal acyclic transducer from words to runs of ids; arrays over states and edges."""

    FIELDS = ("first", "label", "target", "skip", "final", "id_begin", "ids")

    def __init__(self, **arrays: np.ndarray):
        for f in self.FIELDS:
            setattr(self, f, arrays[f])

    @classmethod
    def build(cls, words: list[bytes], ids: np.ndarray, begin: np.ndarray) -> "Lexicon":
        """``words`` sorted and distinct; the ids of word i are ``ids[begin[i]:begin[i + 1]]``."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # final?, edges: [label, state or None while open]
        previous = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(map(tuple, edges)))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][1][-1][1] = register[key]

        for w in words:
            common = 0
            while common < min(len(w), len(previous)) and w[common] == previous[common]:
                common += 1
            close(common)
            for b in w[common:]:
                path[-1][1].append([b, None])
                path.append([False, []])
            path[-1][0] = True
            previous = w
        close(0)
        states.append((path[0][0], tuple(map(tuple, path[0][1]))))
        # states are listed children first, so the words below each are known in this order
        below, first, label, target, skip = [], [0], [], [], []
        for final, edges in states:
            n = int(final)
            for b, to in edges:
                label.append(b)
                target.append(to)
                skip.append(n)
                n += below[to]
            below.append(n)
            first.append(len(label))
        return cls(first=np.array(first, np.int32), label=np.array(label, np.int32), target=np.array(target, np.int32),
                   skip=np.array(skip, np.int32), final=np.array([f for f, _ in states], np.int8),
                   id_begin=np.asarray(begin, np.int32), ids=np.asarray(ids, np.int32))

    def to_bytes(self) -> bytes:
        """The lengths of the arrays, then the arrays, each from a multiple of 8 bytes."""
        out = [np.array([len(getattr(self, x)) for x in self.FIELDS], np.int64).tobytes()]
        for x in self.FIELDS:
            raw = getattr(self, x).tobytes()
            out.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(out)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @classmethod
    def load(cls, path: str) -> "Lexicon":
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        sizes, at, out = raw[:8 * len(cls.FIELDS)].view(np.int64), 8 * len(cls.FIELDS), {}
        for name, n in zip(cls.FIELDS, sizes):
            kind = np.int8 if name == "final" else np.int32
            out[name] = raw[at:at + n * np.dtype(kind).itemsize].view(kind)
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        return cls(**out)

    def number(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the lexicon, -1 if it isn't there: all words walk together, a letter a step."""
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.label):
            return out
        if not hasattr(self, "edge_keys"):
            source = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
            self.edge_keys = source.astype(np.int64) << 8 | self.label
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero(lengths > 0)
        state = np.full(len(live), len(self.first) - 2, np.int64)
        passed = np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | data[begin[live] + step]
            at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            ok = self.edge_keys[at] == key
            live, at, passed = live[ok], at[ok], passed[ok]
            passed, state, step = passed + self.skip[at], self.target[at].astype(np.int64), step + 1
            over = lengths[live] == step
            hit = over & (self.final[state] == 1)
            out[live[hit]] = passed[hit]
            live, state, passed = live[~over], state[~over], passed[~over]
        return out


class Encoder:
    """Chunks of text (between white space of ASCII) to ids, with a bounded memory of what was met before."""

    LIMIT = 150_000

    def __init__(self, table: MergeTable, lexicon: Lexicon | None = None, limit: int = LIMIT):
        self.table, self.lexicon, self.limit = table, lexicon, limit
        self.known: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in pieces]
        counts = np.zeros(len(raw), np.int64)
        number = self.lexicon.number(raw) if self.lexicon is not None else np.full(len(raw), -1, np.int64)
        hit = np.flatnonzero(number >= 0)
        if len(hit):
            id_begin = np.asarray(self.lexicon.id_begin, np.int64)
            counts[hit] = id_begin[number[hit] + 1] - id_begin[number[hit]]
        miss = [i for i in np.flatnonzero(number < 0)]
        special = [i for i in miss if pieces[i] in self.table.special]
        plain = np.array([i for i in miss if pieces[i] not in self.table.special], np.int64)
        ids, begin = self.table.merge([raw[i] for i in plain])
        counts[plain] = np.diff(begin)
        counts[special] = 1
        start = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(start[-1], np.int64)
        for where, source, first in ((hit, np.asarray(self.lexicon.ids, np.int64) if len(hit) else None, id_begin[number[hit]] if len(hit) else None),
                                     (plain, ids, begin[:-1])):
            if len(where):
                n = counts[where]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out[np.repeat(start[where], n) + inside] = source[np.repeat(first, n) + inside]
        for i in special:
            out[start[i]] = self.table.special[pieces[i]]
        return out, start

    def new_chunks(self, rows: list[list[bytes]], known: dict) -> list[bytes]:
        """Chunks of the rows that ``known`` lacks; of a memory grown too large, only what has come back is kept."""
        met = set().union(*rows) if rows else set()
        new = list(met.difference(known))
        if len(known) > self.limit // 2:
            self.again.update(met.difference(new))
        if len(known) > self.limit:
            kept = {c: known[c] for c in self.again}
            known.clear()
            known.update(kept)
            self.again = set()
        return new

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each chunk's begin (one more at the end)."""
        pieces, begin = self.table.pieces(chunks)
        distinct = list(dict.fromkeys(pieces))
        index = dict(zip(distinct, range(len(distinct))))
        ids, start = self.encode_pieces(distinct)
        which = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        n = start[which + 1] - start[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        inside = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
        return ids[np.repeat(start[which], n) + inside], ends[begin]

    def learn(self, rows: list[list[bytes]]) -> dict[bytes, bytes]:
        """Every chunk of the rows: its ids as little-endian unsigned 32-bit numbers."""
        new = self.new_chunks(rows, self.known)
        for lo in range(0, len(new), 1 << 15):
            part = new[lo:lo + (1 << 15)]
            ids, begin = self.encode_chunks(part)
            raw, bounds = ids.astype("<u4").tobytes(), (begin * 4).tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, bounds[:-1], bounds[1:]))))
        return self.known


class Spelling:
    """What each id is written as, followed by a space; ids to text in numpy."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b" ".join(strings) + b" ", np.uint8)
        self.size = np.array([len(s) + 1 for s in strings], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def chunks(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        n = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = self.data[np.repeat(self.begin[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        bounds = ends[begin].tolist()
        return list(map(raw.__getitem__, map(slice, bounds[:-1], bounds[1:])))


#: chunks that an encoder without a lexicon remembers, some 150 bytes each: what it forgets it merges again
MEMORY = 500_000
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of the vocabulary: what one task has learned serves the next."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(merge_table(path), limit=MEMORY)
    return _ENCODERS[path]
