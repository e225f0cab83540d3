"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, one gadget after the other, into a deterministic
automaton over tokens. Its states are the tokens last read. A gadget for the
merge ``u v -> w`` takes the arc ``v`` from the state of ``u``, and adds arcs ``w``
wherever an arc ``u`` starts; the state of ``w`` copies the arcs of the state of
``v``. A token sequence is what the merges make of its text exactly if the
automaton accepts it, so a word is encoded by one pass that asks, at each
position, which token ending there the automaton allows after the token before.

The arc table would have as many entries as the square of the vocabulary. As every
state and every column is a copy taken when its token appeared, an entry is found
by following the copies back; entries that were asked for are kept in a table.

Null texts count as empty and have no tokens. Equal texts have equal ids, and no two
tokens compete: the automaton allows one alone. Rows are judged by themselves, so repeated
rows give equal results, and only the key and the text are read, so extra columns don't
matter. Empty tables give empty results. Very long texts are encoded a million stretches
at a time.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from .shared import KEEPERS, PLAIN, LOWER, U, bounded, hash_words, mixed, spans, split_words, text_bytes, tokenizer_path

#: Beyond this many stretches a worker forgets those it has kept.
KEPT = 500_000
#: Bytes of text that are encoded together, and stretches: the more, the fewer steps for new words.
SPAN, STEP = 8 << 20, 1 << 20


class MergeAutomaton:
    """Which token may follow which, compiled from a list of merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        size = max(vocab.values(), default=-1) + 1
        self.suffix = suffix
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.removed: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        made = {a + b for a, b in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token; their arcs can't be told apart")
        #: Tokens that arcs carry, by their text.
        self.labels = {text: i for text, i in vocab.items() if text not in made}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b], a + b)
        self.longest = max(map(len, self.labels), default=1)

    def _gadget(self, rank: int, u: int, v: int, w: int, text: str) -> None:
        live = self._open(u, v, rank - 1)
        self.left[w], self.right[w], self.rank[w] = u, v, rank
        self.removed[u, v] = rank
        if live:
            self.labels[text] = w

    def _open(self, x: int, y: int, when: int) -> bool:
        """Whether the state of x has an arc y after the first ``when`` + 1 gadgets."""
        removed, rank = self.removed, self.rank
        while True:
            gone = removed.get((x, y))
            if gone is not None and gone <= when:
                return False
            a, b = rank[x], rank[y]
            if a < 0 and b < 0:
                return True
            if x == y:
                x, y, when = self.right[x], self.left[x], a - 1
            elif b > a:
                y, when = self.left[y], b
            else:
                x, when = self.right[x], a - 1

    def follows(self, x: int, y: int) -> bool:
        arc = self.arcs.get((x, y))
        if arc is None:
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            arc = self.arcs[x, y] = self._open(x, y, len(self.rank))
        return arc

    def encode(self, word: str) -> list[int]:
        """Token ids of one word, written in the vocabulary's alphabet."""
        n, labels, follows = len(word), self.labels, self.follows
        whole = labels.get(word + self.suffix)
        if whole is not None and (n == 1 or self.rank[whole] >= 0):
            return [whole]
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            tail = self.suffix if end == n else ""
            for at in range(max(0, end - self.longest), end):
                before = last[at]
                if before >= 0 or not at:
                    token = labels.get(word[at:end] + tail)
                    if token is not None and (not at or follows(before, token)):
                        last[end], start[end] = token, at
                        break
        ids, at = [], n
        while at > 0:
            if last[at] < 0:
                raise ValueError(f"the vocabulary has no token for a part of {word!r}")
            ids.append(last[at])
            at = start[at]
        return ids[::-1]


class WordTable:
    """The automaton's tables as arrays, by which many words are encoded in step.

    Labels are found by a hash of their bytes; whether an arc is there is kept in a direct-mapped table, and asked of the
    automaton where it isn't known yet.
    """

    #: Entries of the arc table; words of more bytes are encoded one by one.
    ARCS, LONGEST = 1 << 20, 48
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, automaton: MergeAutomaton, alphabet: list[str]):
        self.automaton = automaton
        byte = {c: b for b, c in enumerate(alphabet)}
        powers = [pow(self.BASE, i, 1 << 64) for i in range(self.LONGEST)]
        self.up = np.array(powers, np.uint64)
        self.down = np.array([pow(p, -1, 1 << 64) for p in powers], np.uint64)
        keys, ids, longest = [], [], 1
        for text, token in automaton.labels.items():
            for stem, last in ((text, False), (text[: -len(automaton.suffix)], True)) if automaton.suffix and text.endswith(automaton.suffix) else ((text, False),):
                if 0 < len(stem) <= self.LONGEST and all(c in byte for c in stem) and (automaton.rank[token] >= 0 or len(stem) == 1):
                    raw = sum((byte[c] + 1) * p for c, p in zip(stem, powers))
                    keys.append((raw ^ (0xA5A5A5A5A5A5A5A5 if last else 0)) & (1 << 64) - 1)
                    ids.append(token)
                    longest = max(longest, len(stem))
        hashes = mixed(np.array(keys, np.uint64))
        order = np.argsort(hashes)
        self.longest = longest
        self.keys, self.ids = hashes[order], np.array(ids, np.int64)[order]
        self.first = np.searchsorted(self.keys, np.arange((1 << 17) + 1, dtype=np.uint64) << np.uint64(47), "left") if len(keys) else np.zeros((1 << 17) + 1, np.int64)
        self.first[-1] = len(self.keys)
        self.depth = int(np.diff(self.first).max(initial=0))
        self.keys, self.ids = np.append(self.keys, np.zeros(self.depth + 1, np.uint64)), np.append(self.ids, np.full(self.depth + 1, -1))
        self.arc_keys, self.arc_open = np.full(self.ARCS, -1, np.int64), np.zeros(self.ARCS, bool)

    def find(self, raw: np.ndarray, last: bool) -> np.ndarray:
        """Token ids of stretches by their raw hashes, -1 where there is none."""
        h = mixed(raw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if last else mixed(raw)
        at = self.first[(h >> np.uint64(47)).astype(np.int64)]
        out = np.full(len(h), -1)
        for step in range(self.depth):
            hit = self.keys[at + step] == h
            out[hit] = self.ids[at[hit] + step]
        return out

    def open(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which tokens y may follow the tokens x."""
        key = (x << 32) | y
        place = (mixed(key.astype(np.uint64)) & np.uint64(self.ARCS - 1)).astype(np.int64)
        new = np.unique(key[self.arc_keys[place] != key])
        if len(new):
            at, first = np.unique((mixed(new.astype(np.uint64)) & np.uint64(self.ARCS - 1)).astype(np.int64), return_index=True)
            self.arc_keys[at] = new[first]
            self.arc_open[at] = [self.automaton._open(k >> 32, k & 0xFFFFFFFF, len(self.automaton.rank)) for k in new[first].tolist()]
        out = self.arc_open[place]
        for i in np.flatnonzero(self.arc_keys[place] != key).tolist():  # two new arcs at one place
            out[i] = self.automaton.follows(int(x[i]), int(y[i]))
        return out

    def encode(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has. A row of ``block`` is a word; all have the same length, LONGEST at most."""
        m, n = block.shape
        sums = np.zeros((n + 1, m), np.uint64)
        np.cumsum(((block.astype(np.uint64) + np.uint64(1)) * self.up[:n]).T, axis=0, out=sums[1:])
        last, start = np.full((n + 1, m), -1), np.zeros((n + 1, m), np.int16)
        marked = bool(self.automaton.suffix)
        last[n] = self.find(sums[n], marked)
        open_ = np.flatnonzero(last[n] < 0)
        for end in range(1, n + 1):
            left = open_
            for at in range(max(0, end - self.longest), end):
                if not len(left):
                    break
                token = self.find((sums[end, left] - sums[at, left]) * self.down[at], marked and end == n)
                good = np.flatnonzero(token >= 0)
                if at and len(good):
                    good = good[self.open(last[at, left[good]], token[good])]
                if len(good):
                    last[end, left[good]], start[end, left[good]] = token[good], at
                    keep = np.ones(len(left), bool)
                    keep[good] = False
                    left = left[keep]
            if len(left):
                raise ValueError(f"the vocabulary has no token for a part of {block[left[0]].tobytes()!r}")
        at, rows, columns = np.full(m, n), np.arange(m), []
        while at.any():
            columns.append(np.where(at > 0, last[at, rows], -1))
            at = np.where(at > 0, start[at, rows], 0)
        table = np.stack(columns[::-1], 1)
        there = table >= 0
        return table[there].astype("<u4"), there.sum(1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 has a visible one, else the next from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Strings:
    """A growing list of byte strings in one buffer, of which any can be gathered at once."""

    def __init__(self):
        self.data, self.ends, self.n = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64), 0

    def append(self, data: np.ndarray, sizes: np.ndarray) -> None:
        """Adds strings that lie one behind the other in ``data``."""
        used = int(self.ends[self.n])
        for name, least in (("data", used + len(data)), ("ends", self.n + len(sizes) + 1)):
            old = getattr(self, name)
            if len(old) < least:
                grown = np.zeros(2 * least, old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.data[used : used + len(data)] = data
        self.ends[self.n + 1 : self.n + len(sizes) + 1] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings at the given places, one behind the other, and where each begins (one entry more, from 0)."""
        return text_bytes(pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.ends), pa.py_buffer(self.data)]).take(pa.array(at)))


class Places:
    """Places of strings by their 64-bit hash: open addressing, looked up for many hashes at once."""

    SLOTS = 1 << 21

    def __init__(self):
        self.keys, self.at = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't known."""
        slot = (hashes & U(self.SLOTS - 1)).astype(np.int64)
        out = self.at[slot]
        left = np.flatnonzero((self.keys[slot] != hashes) & (out >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.SLOTS - 1
            out[left] = self.at[slot[left]]
            left = left[(self.keys[slot[left]] != hashes[left]) & (out[left] >= 0)]
        return out

    def add(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Hashes that are new and different."""
        slot, left = (hashes & U(self.SLOTS - 1)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.at[slot[left]] < 0]
            self.keys[slot[free]], self.at[slot[free]] = hashes[free], places[free]  # of several in one slot, one stays
            left = left[(self.keys[slot[left]] != hashes[left]) | (self.at[slot[left]] != places[left])]
            slot[left] = (slot[left] + 1) & self.SLOTS - 1


class WordTokenizer:
    """A word-end BPE tokenizer read from a tokenizers JSON file: NFC, one space for white space, lower case, pre-split words, byte alphabet.

    Texts are taken apart at ASCII white space, which no word crosses, for a whole batch of bytes at once. The ids of such stretches are kept
    and found by hash, and their bytes are compared with those asked for; only new stretches are split into words and run through the tables.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(vocab, merges, model["end_of_word_suffix"] or "")
        self.alphabet = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(self.alphabet)}
        self.table = WordTable(self.automaton, self.alphabet)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        # Beyond PINNED what is a letter, a number or a composition changes from one Unicode version to the next: the file's own rules are asked.
        self.rules = tokenizers.Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mark = os.path.commonprefix(list(self.special)).encode() if self.special else b""
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = text
        labels = [(x + " ").encode() for x in self.names]
        self.labels = Strings()
        self.labels.append(np.frombuffer(b"".join(labels), np.uint8), np.array([len(x) for x in labels]))
        self.forget()

    def forget(self) -> None:
        self.places, self.stretches, self.ids = Places(), Strings(), Strings()

    def _split(self, stretch: bytes) -> list[bytes | int]:
        """The words of one stretch; special tokens as their ids."""
        out: list[bytes | int] = []
        text = stretch.decode("utf-8", "replace")
        for part in self.cut.split(text) if self.cut is not None and self.mark in stretch else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif _PINNED(part):
                out += [p.encode() for p in self.pieces(part.lower())]
            elif part:
                words = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(part))
                out += [bytes(map(self.byte.__getitem__, word)) for word, _ in words]
        return out

    def _words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
        """Of stretches one behind the other: bytes of all their words, the sizes of these, how many each stretch has, and which are special tokens."""
        bounds = np.append(0, np.cumsum(sizes))
        kind = _KIND[data]
        plain = np.maximum.reduceat(kind, bounds[:-1]) < 3 if len(sizes) else np.zeros(0, bool)
        inside = np.repeat(plain, sizes)
        some = data[inside]
        if len(some):
            own, ends = kind[inside], np.cumsum(sizes[plain])
            first = np.append(True, (own[1:] != own[:-1]) | (own[1:] == 1))
            first[ends[:-1]] = True
            starts = np.flatnonzero(first)
            word_sizes = np.diff(starts, append=len(some))
            counts = np.zeros(len(sizes), np.int64)
            counts[plain] = np.diff(np.searchsorted(starts, np.append(0, ends)))
        else:
            word_sizes, counts = np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        odd = np.flatnonzero(~plain)
        if not len(odd):
            return LOWER[some], word_sizes, counts, {}
        raw = data.tobytes()
        split = [self._split(raw[bounds[i] : bounds[i + 1]]) for i in odd.tolist()]
        counts[odd] = [len(x) for x in split]
        # All words in the order of their stretches.
        more = [b"\0" if isinstance(w, int) else w for x in split for w in x]
        order = np.argsort(np.concatenate([np.repeat(np.flatnonzero(plain), counts[plain]), np.repeat(odd, counts[odd])]), kind="stable")
        both = Strings()
        both.append(LOWER[some], word_sizes)
        both.append(np.frombuffer(b"".join(more), np.uint8), np.array([len(w) for w in more], np.int64))
        words, cuts = both.gather(order)
        place = np.argsort(order)[len(word_sizes) :]
        marks = {int(place[k]): w for k, w in enumerate(w for x in split for w in x) if isinstance(w, int)}
        return words, np.diff(cuts), counts, marks

    def _learn(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keeps the ids of stretches that lie one behind the other, and says where."""
        words, word_sizes, counts, marks = self._words(data, sizes)
        ends = np.cumsum(word_sizes)
        starts = ends - word_sizes
        if len(words):
            _, first, again = np.unique(hash_words(words, starts, ends), return_index=True, return_inverse=True)
            if not np.array_equal(word_sizes, word_sizes[first][again]) or not np.array_equal(words, words[_spread(starts[first][again], word_sizes)]):
                first = again = np.arange(len(word_sizes))  # two words with one hash
        else:
            first = again = np.zeros(0, np.int64)
        ids, made, n = Strings(), np.zeros(len(first), np.int64), word_sizes[first]
        for size in np.unique(n).tolist():
            group = np.flatnonzero(n == size)
            block = words[starts[first[group]][:, None] + np.arange(size)]
            if size <= WordTable.LONGEST:
                flat, each = self.table.encode(block)
            else:
                lists = [self.automaton.encode("".join(self.alphabet[b] for b in row.tolist())) for row in block]
                flat, each = np.array([i for x in lists for i in x], "<u4"), np.array([len(x) for x in lists])
            made[group] = np.arange(ids.n, ids.n + len(group))
            ids.append(flat.view(np.uint8), 4 * each)
        at = made[again]
        if marks:
            ids.append(np.array(list(marks.values()), "<u4").view(np.uint8), np.full(len(marks), 4))
            at[list(marks)] = np.arange(ids.n - len(marks), ids.n)
        flat, cuts = ids.gather(at)
        self.stretches.append(data, sizes)
        self.ids.append(flat, np.diff(cuts[np.append(0, np.cumsum(counts))]))
        return np.arange(self.ids.n - len(sizes), self.ids.n)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of STEP stretches at most, and how many each has."""
        sizes, hashes = ends - starts, hash_words(data, starts, ends)
        at = self.places.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.ids.n > KEPT:
                self.forget()
                new = np.arange(len(hashes))
            keys, first = np.unique(hashes[new], return_index=True)
            first = new[first]
            self.places.add(keys, self._learn(data[_spread(starts[first], sizes[first])], sizes[first]))
            at[new] = self.places.find(hashes[new])
        asked = data[starts[0] : ends[-1]]
        asked = asked[PLAIN[asked]]
        held, cuts = self.stretches.gather(at)
        if not np.array_equal(np.diff(cuts), sizes) or not np.array_equal(held, asked):
            # Stretches with the hash of another one are learned by themselves.
            own = np.append(0, np.cumsum(sizes))
            other = np.array([i for i in range(len(sizes)) if held[cuts[i] : cuts[i + 1]].tobytes() != asked[own[i] : own[i + 1]].tobytes()])
            at[other] = self._learn(data[_spread(starts[other], sizes[other])], sizes[other])
        flat, cuts = self.ids.gather(at)
        return flat.view("<u4"), np.diff(cuts) // 4

    def encode_column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow column, one behind the other, and where each text's begin (one entry more)."""
        data, offsets = text_bytes(texts)
        starts, ends, bounds = split_words(data, offsets, PLAIN)
        parts = [self._encode(data, starts[a : a + STEP], ends[a : a + STEP]) for a in range(0, len(starts), STEP)]
        if not parts:
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        return np.concatenate([p[0] for p in parts]), np.append(0, np.cumsum(np.concatenate([p[1] for p in parts])))[bounds]

    def decode_column(self, ids: np.ndarray, cuts: np.ndarray) -> pa.LargeBinaryArray:
        """For the ids of texts one behind the other: the labels of the arcs that they follow, with a space between them, special tokens included."""
        data, at = self.labels.gather(ids.astype(np.int64))
        at = at[cuts]
        full = np.flatnonzero(np.diff(at))
        keep = np.ones(len(data), bool)
        keep[at[full + 1] - 1] = False
        at = at - np.append(0, np.cumsum(np.diff(at) > 0))
        return binary(data[keep], at)

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text]))[0].tobytes()

    def decode(self, ids: bytes) -> str:
        own = np.frombuffer(ids, "<u4")
        return self.decode_column(own, np.array([0, len(own)]))[0].as_py().decode()


def binary(data: np.ndarray, cuts: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the bytes of stretches with the given starts and sizes."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


#: Classes of bytes in ASCII text: letters, digits, others; 3 for what the regular expression is asked about.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 0
_KIND[0x30:0x3A] = 1
_KIND[[ord("'"), ord("<"), *range(0x80, 0x100)]] = 3
#: Texts of characters that every version of Unicode since 5 treats alike, and that no normalisation changes.
_PINNED = re.compile("[\0-\u024f\u0400-\u045f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+").fullmatch


@lru_cache(4)
def tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer with its cache of words, kept until another operator runs there."""
    KEEPERS["bpe"] = tokenizer.cache_clear
    return WordTokenizer(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """Every row's key, n_tokens, ids (binary, little-endian unsigned 32-bit) and, if wanted, the text decoded from them.

    One narrow map over the rows: no shuffle, bounded memory (texts are taken a few MB at a time).
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    bounded(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    fields = [rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    schema = T.StructType(fields + [T.StructField("decoded", T.StringType())] * decoded)

    def encode(batches):
        own = tokenizer(path)
        for part in spans(batches, "text", SPAN, "bpe"):
            ids, cuts = own.encode_column(part.column("text"))
            columns = [part.column(0), pa.array(np.diff(cuts)), binary(ids.view(np.uint8), 4 * cuts).cast(pa.binary())]
            names = [key, "n_tokens", "ids"]
            if decoded:
                columns.append(own.decode_column(ids, cuts).cast(pa.binary()).cast(pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Each row's key and the text its ids stand for."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    bounded(encoded.sparkSession)
    rows = encoded.select(F.col(key), F.col(ids).alias("ids"))

    def decode(batches):
        own = tokenizer(path)
        for part in spans(batches, "ids", keeper="bpe"):
            data, cuts = text_bytes(part.column("ids"))
            text = own.decode_column(np.frombuffer(data.tobytes(), "<u4"), cuts // 4)
            yield pa.RecordBatch.from_arrays([part.column(0), text.cast(pa.binary()).cast(pa.string())], names=[key, "decoded"])

    return rows.mapInArrow(decode, T.StructType([rows.schema[0], T.StructField("decoded", T.StringType())]))


def default_path() -> str:
    return tokenizer_path("word_bpe_49k.json")
