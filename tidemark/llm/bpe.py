"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words, counted over all documents, are compiled with their ids into a deterministic
acyclic automaton whose equal suffixes are shared. Every arc carries a number; their sum along a
word is the word's index in a table of id sequences. The compiled lexicon is one flat file that
workers map into memory. A word that it does not hold is merged exactly, by the vocabulary's ranks.

The vocabulary is a tokenizers JSON file of the word-end kind: NFC, white space, lower case, a
split by a fixed pattern, byte-level characters, `</w>` at word ends, no decoder.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import counted_only, hand_out, kept, shared_dir
from tidemark.llm.wordhash import slices

#: Text bytes taken at a time.
STEP = 3 << 20
#: Words, and pieces of text, that a worker remembers from one part of its rows to the next.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A tokenizer file: ids, merge ranks, special tokens and the pre-tokenizer's pattern."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        #: by (left id, right id) in one number: rank and merged id in one number
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[(self.ids[a] << 32) | self.ids[b]] = (rank << 32) | self.ids[a + b]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._chars = byte_characters()
        self._bytes = {c: b for b, c in enumerate(self._chars)}
        self._inner = [self.ids[c] for c in self._chars]
        self._last = [self.ids[c + self.suffix] for c in self._chars]
        self._inner_ids, self._last_ids = np.array(self._inner, np.int64), np.array(self._last, np.int64)
        self._pairs, self._merged = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, _NO_RANK)
        key, merged = (np.array(x, np.int64) for x in zip(*self.ranks.items(), strict=True))
        slot = _slot(key)
        while len(key):  # open addressing: of the keys that want a free slot, the last one gets it
            free = self._pairs[slot] < 0
            self._pairs[slot[free]] = key[free]
            placed = self._pairs[slot] == key
            self._merged[slot[placed]] = merged[placed]
            key, merged, slot = key[~placed], merged[~placed], (slot[~placed] + 1) % _SLOTS
        self._source, self._library = source, None

    def _split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens.

        Scripts whose Unicode tables differ between versions are left to the library's own normaliser
        and splitter, so that its version of the tables holds.
        """
        if text.isascii():  # a piece has no white space that normalising would change
            return self.words(text.lower())
        if _UNSETTLED.search(text) is None:
            return self.words(normalise(text))
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._source)
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._bytes[c] for c in piece).decode() for piece, _ in found]

    def merge(self, word: str) -> list[int]:
        """The ids of one pre-token: again and again the pair of lowest rank is merged, the leftmost of equal ones."""
        raw = word.encode()
        if not raw:
            return []
        parts = [self._inner[b] for b in raw]
        parts[-1] = self._last[raw[-1]]
        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        # rank and place of every pair in one number; entries that a merge has made untrue are passed over
        heap = [(found & _RANK) | i for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (found := get((pair[0] << 32) | pair[1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if parts[i] < 0 or j >= n:
                continue
            found = get((parts[i] << 32) | parts[j])
            if found is None or found >> 32 != entry >> 32:
                continue
            parts[i], parts[j] = found & 0xFFFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := get((parts[i] << 32) | parts[k])) is not None:
                    heappush(heap, (found & _RANK) | i)
            h = before[i]
            if h >= 0 and (found := get((parts[h] << 32) | parts[i])) is not None:
                heappush(heap, (found & _RANK) | h)
        return [x for x in parts if x >= 0]

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """`merge` for many words at once: those of one length advance together, one merge a round."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[list[int]] = [[] for _ in raw]
        for length in np.unique(size).tolist():
            rows = np.flatnonzero(size == length)
            if not length or length > 64 or len(rows) < 4:
                for r in rows.tolist():
                    out[r] = self.merge(words[r])
                continue
            data = np.frombuffer(b"".join([raw[r] for r in rows.tolist()]), np.uint8).reshape(-1, length)
            ids = self._inner_ids[data]
            ids[:, -1] = self._last_ids[data[:, -1]]
            rank = self._rank(ids[:, :-1], ids[:, 1:])
            while len(rows):
                at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
                best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), _NO_RANK)
                done = best == _NO_RANK
                if done.any():
                    for r, found in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                        out[r] = found
                    rows, ids, rank, at, best = rows[~done], ids[~done], rank[~done], at[~done], best[~done]
                    if not len(rows):
                        break
                each, width = np.arange(len(rows)), ids.shape[1] - 1
                ids[each, at] = best & 0xFFFFFFFF
                place = np.arange(width)
                ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
                place = np.arange(width - 1)
                rank = np.take_along_axis(rank, place + (place >= at[:, None]), axis=1)
                left = np.flatnonzero(at > 0)
                rank[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
                right = np.flatnonzero(at < width - 1)
                rank[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = ((a << 32) | b).ravel()
        slot = _slot(key)
        held = self._pairs[slot]
        out = np.where(held == key, self._merged[slot], _NO_RANK)
        rest = np.flatnonzero((held != key) & (held >= 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) % _SLOTS
            held = self._pairs[slot]
            hit = held == key[rest]
            out[rest[hit]] = self._merged[slot[hit]]
            on = ~hit & (held >= 0)
            rest, slot = rest[on], slot[on]
        return out.reshape(a.shape)

    def chunks(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """Pieces between white space, which no pre-token crosses, and special tokens among them (True, [token])."""
        if self.specials is not None and "<|" in text:
            for i, piece in enumerate(self.specials.split(text)):
                if i % 2:
                    yield True, [piece]
                else:
                    yield False, _pieces(piece)
        else:
            yield False, _pieces(text)

    def pretokens(self, chunk: str) -> list[str]:
        """The pre-tokens of a piece without white space and special tokens."""
        if chunk.isalpha():
            return [chunk.lower()] if chunk.isascii() or max(chunk) < _PLAIN else self._split(chunk)
        word = chunk[:-1]
        if chunk[-1:] in _STOPS and word.isalpha() and (word.isascii() or max(word) < _PLAIN):
            return [word.lower(), chunk[-1]]
        return self._split(chunk)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, word ends and special tokens left as they are: the file has no decoder."""
        return " ".join([self.tokens[i] for i in ids])


#: Characters outside the blocks that have been full for many versions of Unicode.
_UNSETTLED = regex.compile(r"[^\x00-\u0527\u1e00-\u1eff\u2000-\u2064\u20a0-\u20bd\u2100-\u2189\u2190-\u23f0\u2500-\u27bf\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fcc\uac00-\ud7a3]")
_SPACES = regex.compile(r"\p{White_Space}+")
#: Separators that Python takes for white space and Unicode does not.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_NO_RANK = 1 << 62
#: The rank in a number of rank and merged id.
_RANK = ~0xFFFFFFFF
#: Slots of the hash table of merges.
_SLOTS = 1 << 18


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


#: Below this character letters are their own normal form and have one lower-case letter each.
_PLAIN = "\u0130"
_STOPS = frozenset(",.;:!?")


def _pieces(text: str) -> list[str]:
    if _SEPARATORS.search(text) is None:
        return text.split()
    return [x for x in _SPACES.split(text) if x]


def normalise(text: str) -> str:
    """NFC, runs of white space to one space, each character to lower case by itself (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return _SPACES.sub(" ", text).lower()


@dataclass
class Lexicon:
    """The automaton in flat arrays. State s has the arcs first[s] to first[s + 1], ordered by byte."""

    first: np.ndarray
    byte: np.ndarray
    target: np.ndarray
    number: np.ndarray
    final: np.ndarray
    offset: np.ndarray
    ids: np.ndarray

    KINDS = (("first", np.int32), ("byte", np.uint8), ("target", np.int32), ("number", np.int32), ("final", np.uint8), ("offset", np.int32), ("ids", np.int32))

    def dump(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, name), kind) for name, kind in self.KINDS]
        head = np.array([len(a) for a in arrays], np.int64).tobytes()
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """The arrays of a dumped lexicon, views of the file mapped into memory."""
        with open(path, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(raw)
        sizes = view[: 8 * len(cls.KINDS)].cast("q").tolist()
        at, arrays = 8 * len(cls.KINDS), []
        for size, (name, kind) in zip(sizes, cls.KINDS, strict=True):
            n = size * np.dtype(kind).itemsize
            arrays.append(view[at : at + n].cast(np.dtype(kind).char) if name != "byte" else (raw, at))
            at += n + -n % 8
        return cls(*arrays)

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if the lexicon does not hold it (on a loaded lexicon)."""
        state = index = 0
        first, target, number, (raw, base) = self.first, self.target, self.number, self.byte
        for i in range(len(word)):
            arc = raw.find(word[i : i + 1], base + first[state], base + first[state + 1])
            if arc < 0:
                return None
            index += number[arc - base]
            state = target[arc - base]
        if not self.final[state]:
            return None
        return self.ids[self.offset[index] : self.offset[index + 1]].tolist()


    def find_many(self, words: list[bytes]) -> list[list[int] | None]:
        """`find` for many words at once: all advance along the automaton together."""
        raw, base = self.byte
        first, target, number, final, offset, ids = (np.asarray(x) for x in (self.first, self.target, self.number, self.final, self.offset, self.ids))
        byte = np.frombuffer(raw, np.uint8, len(target), base)
        arcs = (np.repeat(np.arange(len(final)), np.diff(first)) << 8) | byte
        out: list[list[int] | None] = [None] * len(words)
        if not len(arcs) or not words:
            return out
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        alive, state, index = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            ended = size[alive] == step
            for w, s, i in zip(alive[ended].tolist(), state[ended].tolist(), index[ended].tolist(), strict=True):
                if final[s]:
                    out[w] = ids[offset[i] : offset[i + 1]].tolist()
            alive, state, index = alive[~ended], state[~ended], index[~ended]
            key = (state << 8) | text[start[alive] + step]
            at = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            on = arcs[at] == key
            alive, state, index = alive[on], target[at[on]].astype(np.int64), index[on] + number[at[on]]
            step += 1
        return out


def compile_lexicon(entries: dict[bytes, list[int]]) -> Lexicon:
    """The minimal automaton of `entries`, built word by word in byte order; equal tails become one state."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[int] = [0]
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            child, parent = path.pop(), path[-1]
            key = (final[child], tuple(arcs[child].items()))
            same = register.setdefault(key, child)
            if same != child:
                arcs[parent][last[len(path) - 1]] = same

    for word in sorted(entries):
        common = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        settle(common)
        for b in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    words: dict[int, int] = {}
    order: list[int] = []
    stack = [(0, False)]
    while stack:  # children before parents
        state, ready = stack.pop()
        if state in words:
            continue
        if ready:
            words[state] = int(final[state]) + sum(words[t] for t in arcs[state].values())
            order.append(state)
        else:
            stack.append((state, True))
            stack += [(t, False) for t in arcs[state].values() if t not in words]
    place = {state: i for i, state in enumerate(reversed(order))}  # the root comes first
    first, byte, target, number, ends = [0], [], [], [], []
    for state in place:
        before = int(final[state])
        for b, t in sorted(arcs[state].items()):
            byte.append(b)
            target.append(place[t])
            number.append(before)
            before += words[t]
        ends.append(final[state])
        first.append(len(byte))
    ids = [entries[w] for w in sorted(entries)]
    return Lexicon(
        np.array(first), np.array(byte, np.uint8), np.array(target), np.array(number), np.array(ends), np.cumsum([0, *map(len, ids)]), np.array([i for x in ids for i in x], np.int32)
    )


@lru_cache(maxsize=4)
def _vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


@lru_cache(maxsize=4)
def _lexicon(name: str) -> Lexicon:
    return Lexicon.load(SparkFiles.get(name))


def count_words(docs: DataFrame, source: str) -> DataFrame:
    """word, n: the pre-tokens of all whole texts and how often each occurs. Each batch sends every word once."""
    shared = docs.sparkSession.sparkContext.broadcast(source)

    @counted_only
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            for part in slices(batch, "text", STEP):
                pieces: Counter[str] = Counter()
                for text in part.column("text").to_pylist():
                    for special, chunk in vocabulary.chunks(text or ""):
                        if not special:
                            pieces.update(chunk)
                found: Counter[str] = Counter()
                for piece, n in pieces.items():
                    for word in vocabulary.pretokens(piece):
                        found[word] += n
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, source: str, most_words: int = 50_000) -> Lexicon:
    """The lexicon of at most `most_words` words, the most frequent of all documents.

    Words are taken by classes of about equal frequency (sixteen to a doubling), the most frequent classes
    first, as long as whole classes fit, so the driver gets no more than those words.
    """
    vocabulary = Vocabulary(source)
    shared_dir(docs.sparkSession)
    counts = count_words(docs, source).withColumn("class", F.floor(F.log2("n") * 16)).checkpoint()
    least, total = None, 0
    for row in sorted(counts.groupBy("class").count().collect(), reverse=True):  # at most 1,024 classes
        total += row["count"]
        if total > most_words:
            break
        least = row["class"]
    top = counts.where(F.lit(False) if least is None else F.col("class") >= least).select("word").collect()
    return compile_lexicon({r["word"].encode(): vocabulary.merge(r["word"]) for r in top})


def encode(docs: DataFrame, tokenizer: str, keep: list[str], *, ids: bool = False, most_words: int = 50_000) -> DataFrame:
    """Columns `keep` of `docs` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and decoded.

    tokenizer: path of the vocabulary file, read on the driver. ids_sha256 is of the decimal ids joined
    by one space, decoded_sha256 of the text decoded from those ids.

    Normalising and splitting is our own work except in pieces with characters outside `_UNSETTLED`'s blocks
    (Arabic, Hebrew, Thai, Indic and Armenian letters, emoji, rarer CJK): those go through the library's
    normaliser and splitter, as its version of the Unicode tables decides there. Lexicon and merges are always ours.

    Edge cases: a null text counts as empty and has no token; a special token's string inside a text
    becomes its id, as the tokenizers library has it; repeated rows stay; a kept column named like a result is
    replaced by it; other columns do not matter. A word takes time by n log n of its length.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    spark = docs.sparkSession
    name = hand_out(spark, build_lexicon(docs, source, most_words).dump(), "lexicon")
    shared = spark.sparkContext.broadcast(source)
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]
    keep, kept_columns, types = kept(docs, keep, results)

    @counted_only
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, lexicon = _vocabulary(shared.value), _lexicon(name)

        # number of tokens, their ids, the text they decode to: of pre-tokens, and of pieces without white space
        numerals = {i: str(i) for i in vocabulary.tokens}
        words: dict[str, tuple[int, str, str]] = {}
        pieces: dict[str, tuple[int, str, str]] = {}

        def learn(new: set[str]) -> None:
            """Puts `new` pieces and their pre-tokens into the memories."""
            if len(words) > REMEMBERED:
                words.clear()
            split = {piece: vocabulary.pretokens(piece) for piece in new}
            unknown = list({w for found in split.values() for w in found}.difference(words))
            ids = lexicon.find_many([w.encode() for w in unknown])
            unseen = [i for i, found in enumerate(ids) if found is None]
            for i, found in zip(unseen, vocabulary.merge_many([unknown[i] for i in unseen]), strict=True):
                ids[i] = found
            for word, found in zip(unknown, ids, strict=True):
                words[word] = (len(found), " ".join([numerals[i] for i in found]), vocabulary.decode(found))
            for piece, found in split.items():
                parts = [words[w] for w in found if words[w][0]]
                pieces[piece] = parts[0] if len(parts) == 1 else (sum([x[0] for x in parts]), " ".join([x[1] for x in parts]), " ".join([x[2] for x in parts]))

        for batch in batches:
            for part in slices(batch, "text", STEP):
                columns: dict[str, list] = {k: [] for k in ("n", "i", "d", "ids", "decoded")}
                texts = [list(vocabulary.chunks(text or "")) for text in part.column("text").to_pylist()]
                asked: set[str] = set()
                for text in texts:
                    for special, chunk in text:
                        if not special:
                            asked.update(chunk)
                if len(pieces) > REMEMBERED:
                    pieces.clear()
                learn(asked.difference(pieces))
                for text in texts:
                    got: list[tuple[int, str, str]] = []
                    for special, chunk in text:
                        if special:
                            i = vocabulary.special[chunk[0]]
                            got.append((1, str(i), vocabulary.decode([i])))
                        else:
                            got += map(pieces.__getitem__, chunk)
                    got = [x for x in got if x[0]]
                    numbers, decoded = " ".join([x[1] for x in got]), " ".join([x[2] for x in got])
                    columns["n"].append(sum([x[0] for x in got]))
                    columns["i"].append(hashlib.sha256(numbers.encode()).hexdigest())
                    columns["d"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        columns["ids"].append(np.array(numbers.split(), np.int32))
                        columns["decoded"].append(decoded)
                arrays = [pa.array(columns["n"], pa.int64()), pa.array(columns["i"], pa.string()), pa.array(columns["d"], pa.string())]
                if ids:
                    arrays += [pa.array(columns["ids"], pa.list_(pa.int32())), pa.array(columns["decoded"], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(keep))), *arrays], [*(f"k{i}" for i in range(len(keep))), *results])

    renamed = docs.select(*kept_columns, F.col("text").cast("string").alias("text"))
    ddl = ", ".join([*([types] if types else []), "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["ids array<int>, decoded string"] if ids else [])])
    return renamed.mapInArrow(run, ddl).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *results)
