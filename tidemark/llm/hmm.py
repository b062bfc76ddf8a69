"""A hidden Markov language model: latent states over words, trained by Baum-Welch over all training texts.

* Word counts of all training texts give the vocabulary. States emit symbols: each of the most frequent words is a
  symbol of its own, the others share symbols by their last bytes, and within such a symbol a word has the share
  (c + 0.1) / (all of the symbol + 0.1), which no state changes; a word never seen counts as c = 0. So the model covers
  every word, but its tables have a fixed size and are broadcast.
* Texts become symbols once. In a pass of Baum-Welch each task runs the scaled forward and backward recursions over
  its texts, cut into segments, and sends expected counts on; Spark sums them by symbol. Every pass, from the first
  on, runs over all training texts.
* A score is the exact likelihood of the whole text by the scaled forward recursion. A very long text is cut into
  blocks whose transfer matrices are found side by side and multiplied in order; that changes nothing in the result.
* Counts of rarer words, which grow with the corpus, are not broadcast: they are joined by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import batches_of, counted_only, kept, shared_dir
from tidemark.llm.wordhash import LOWER, SPACE, Words, flat, mix, slices

#: Text bytes taken at a time.
STEP = 1 << 20
#: Pseudo-count of every word, as in the base measure.
ADD = 0.1
#: The symbol of the end of a text.
END = 0
#: Symbols of a training segment, segments side by side, and symbols of a block of a long text.
SEGMENT, SIDE, BLOCK = 256, 4096, 4096
#: First bits of hashes that tell where to look among the words at hand.
BITS = 18
#: Distinct words that a task counts before it sends them on.
COUNTED = 1 << 20


@dataclass
class Vocabulary:
    """Counts of the frequent words by hash, the symbol of each (0 where its ending decides), the shared symbols' masses, and totals."""

    word: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    own: int
    mass: np.ndarray
    tokens: int
    types: int
    texts: int

    @property
    def symbols(self) -> int:
        return 1 + self.own + len(self.mass)

    @property
    def space(self) -> float:
        """What counts are divided by in the base measure."""
        return self.tokens + ADD * (self.types + 1)

    def prior(self) -> np.ndarray:
        """The share of each symbol among the training tokens, none of them zero."""
        weight = np.full(self.symbols, ADD)
        weight[END] += self.texts
        weight[self.symbol[self.symbol > 0]] += self.count[self.symbol > 0]
        weight[1 + self.own :] += self.mass
        return weight / weight.sum()


@dataclass
class Model:
    """Start probabilities of texts and of later segments, transitions, and emissions by symbol."""

    start: np.ndarray
    inside: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def words_of(texts: pa.Array, endings: int) -> tuple[Words, np.ndarray]:
    """The words of texts, and the number of each word's ending: a hash of its last three bytes."""
    words = Words(*flat(texts), SPACE, LOWER)
    tail = words._between(np.maximum(words.start, words.end - 3), words.end)
    return words, (mix(tail) % np.uint64(endings)).astype(np.int64)


def count_words(docs: DataFrame, endings: int) -> DataFrame:
    """hash, ending, n: the words of all texts and how often they occur; counted in each task first."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        hashes, ending, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        word, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        return word, ending[first], np.bincount(of, weights=n, minlength=len(word)).astype(np.int64)

    def send(part: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(part[0]), 1 << 17):
            word, ending, n = (x[a : a + (1 << 17)] for x in part)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ending, pa.int64()), pa.array(n, pa.int64())], ["hash", "ending", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, fresh = None, []
        for batch in batches:
            for part in slices(batch, "text", STEP):
                words, ending = words_of(part.column("text"), endings)
                word, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                fresh.append((word, ending[first], n))
                if sum(len(x[0]) for x in fresh) > COUNTED // 2:
                    have, fresh = merged([*([have] if have else []), *fresh]), []
                    if len(have[0]) > COUNTED:
                        yield from send(have)
                        have = None
        if have or fresh:
            yield from send(merged([*([have] if have else []), *fresh]))

    return docs.select("text").mapInArrow(counted_only(count), "hash long, ending long, n long").groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, texts: int, own: int, known: int, endings: int) -> Vocabulary:
    """At most `own` words with a symbol each and at most `known` words with counts at hand; words of one frequency class of a sixteenth of an octave go together."""
    cls = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["cls"], r["words"], r["total"]) for r in counts.groupBy(cls.alias("cls")).agg(F.count("*").alias("words"), F.sum("n").alias("total")).collect()), reverse=True)

    def border(most: int) -> int:
        total, last = 0, 1 << 30
        for c, words, _ in sizes:
            total += words
            if total > most:
                break
            last = c
        return last

    own_from, known_from = border(own), border(known)
    got = counts.where(cls >= known_from).select("hash", "n", (cls >= own_from).alias("own")).toArrow()  # `known` rows at most
    word = got.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(word)
    has = got.column("own").to_numpy()[order]
    mass = np.zeros(endings)
    for r in counts.where(cls < own_from).groupBy("ending").agg(F.sum(F.col("n") + F.lit(ADD)).alias("mass")).collect():  # a row for each ending
        mass[r["ending"]] = r["mass"]
    tokens, types = sum(x[2] for x in sizes), sum(x[1] for x in sizes)
    return Vocabulary(word[order], got.column("n").to_numpy()[order], np.where(has, np.cumsum(has), 0), int(has.sum()), mass, tokens + texts, types + (texts > 0), texts)


def _places(word: np.ndarray, begin: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """What searchsorted gives for hashes among sorted ones, found from where their first BITS bits begin: a step or two instead of all halvings."""
    at = begin[(hashes >> np.uint64(64 - BITS)).astype(np.intp)]
    left = np.arange(len(at)) if len(word) else np.zeros(0, np.intp)
    while len(left):
        left = left[at[left] < len(word)]
        left = left[word[at[left]] < hashes[left]]
        at[left] += 1
    return at


def encoded(rows: DataFrame, types: str, text: str, vocab) -> DataFrame:
    """The rows with symbols as 16-bit numbers, counts, sums of logarithms, and the words whose counts are not at hand.

    known_log: sum of log10(c + 0.1) over tokens with counts at hand; share_log: what the words within shared symbols add to the
    model's score, but for log10(c + 0.1) of the words listed in `rare`, which occur `times` times.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        log, mass_log = np.log10(v.count + ADD), np.log10(v.mass + ADD)
        end_log = np.log10(v.texts + ADD)
        begin = np.searchsorted(v.word, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS))
        for batch in batches:
            for part in slices(batch, text, STEP):
                words, ending = words_of(part.column(text), len(v.mass))
                at = _places(v.word, begin, words.hash)
                at[at == len(v.word)] = 0
                there = v.word[at] == words.hash if len(v.word) else np.zeros(len(at), bool)
                symbol = np.where(there, v.symbol[at], 0) if len(v.word) else np.zeros(len(at), np.int64)
                shared = symbol == 0
                symbol = np.where(shared, 1 + v.own + ending, symbol)
                known = np.where(there, log[at], 0.0) if len(v.word) else np.zeros(len(at))
                share = np.where(shared, known - mass_log[ending], 0.0)
                row, n = words.row_of(), part.num_rows
                # an end behind each text
                out = np.zeros(len(symbol) + n, np.uint16)
                out[np.arange(len(symbol)) + row] = symbol
                ends = words.first + np.arange(n + 1)
                seq = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(out)])
                rare = np.flatnonzero(~there)
                order = rare[np.lexsort((words.hash[rare], row[rare]))]
                fresh = np.append(True, (row[order][1:] != row[order][:-1]) | (words.hash[order][1:] != words.hash[order][:-1])) if len(order) else np.zeros(0, bool)
                start = np.flatnonzero(fresh)
                times = np.diff(np.append(start, len(order)))
                of = np.searchsorted(row[order[start]], np.arange(n + 1)).astype(np.int32)
                columns = [
                    pa.array(np.diff(ends)), pa.array(np.bincount(row[there], minlength=n) + (v.texts > 0)), pa.array(np.bincount(row, weights=known, minlength=n) + end_log), pa.array(np.bincount(row, weights=share, minlength=n)),
                    seq, pa.ListArray.from_arrays(pa.array(of), pa.array(words.hash[order[start]].view(np.int64))), pa.ListArray.from_arrays(pa.array(of), pa.array(times.astype(np.int32))),
                ]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                have = [c for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in have), *(c.cast(k) for c, k in zip(columns, kinds, strict=True))], [*have, "tokens", "known", "known_log", "share_log", "seq", "rare", "times"])

    return rows.mapInArrow(counted_only(encode), f"{types}, tokens long, known long, known_log double, share_log double, seq binary, rare array<bigint>, times array<int>")


def _side_by_side(parts: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """The symbols of sequences of falling length, all first ones, then all second ones and so on, and where each of these runs begins; last, where the last ends."""
    length = np.array([len(p) for p in parts])
    begin, every = np.cumsum(length) - length, np.concatenate(parts)
    at = np.append(0, np.cumsum(np.searchsorted(-length, -np.arange(length[0]) - 1, side="right"))).tolist()
    run = np.empty(len(every), np.uint16)
    for t, (a, b) in enumerate(zip(at, at[1:])):
        run[a:b] = every[begin[: b - a] + t]
    return run, at


def expected(model: Model, parts: list[np.ndarray], first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Adds the expected emissions of segments of falling length to `counts`; their expected starts (of texts, of later segments), moves, and log likelihood.

    Tables have a row for each state, so that sums over states and products run along many segments, not along a few states.
    """
    run, at = _side_by_side(parts)
    symbols, k = run.astype(np.intp), len(model.start)
    move, into, emit = model.move.astype(np.float32), model.move.T.astype(np.float32), np.ascontiguousarray(model.emit.T)
    seen, alpha, scale = np.empty((k, len(run)), np.float32), np.empty((k, len(run)), np.float32), np.empty(len(run), np.float32)
    for j in range(k):
        np.take(emit[j], symbols, out=seen[j], mode="clip")
    now = np.where(first, model.start[:, None], model.inside[:, None]).astype(np.float32)
    for a, b in zip(at, at[1:]):
        now = np.multiply(now[:, : b - a], seen[:, a:b], out=alpha[:, a:b])
        one = np.reciprocal(now.sum(axis=0, out=scale[a:b]))
        now *= one
        seen[:, a:b] *= one
        now = into @ now
    beta, moves = np.ones((k, len(parts)), np.float32), np.zeros((k, k))
    for t in range(len(at) - 2, 0, -1):
        z, a, b = at[t - 1 : t + 2]
        ahead = seen[:, a:b]
        ahead *= beta[:, : b - a]
        moves += alpha[:, z : z + b - a] @ ahead.T
        np.matmul(move, ahead, out=beta[:, : b - a])
        alpha[:, z:a] *= beta[:, : a - z]  # now the states' probabilities there
    for j in range(k):
        counts[:, j] += np.bincount(symbols, weights=alpha[j], minlength=len(counts))
    begun = alpha[:, : len(parts)]
    return np.vstack([begun[:, first].sum(axis=1), begun[:, ~first].sum(axis=1), model.move * moves, np.full(k, np.log(scale, dtype=np.float64).sum() / k)])


def improved(vocab: Vocabulary, moved: np.ndarray, emitted: np.ndarray) -> Model:
    """The model of expected counts; to what a state emits, as many tokens of the overall distribution are added as it emits different symbols (Witten-Bell)."""
    emit = emitted + (1 + (emitted > 0.5).sum(axis=0)) * vocab.prior()[:, None]
    start, inside, move = moved[0] + 0.1, moved[1] + 0.1, moved[2:-1] + 0.1
    return Model(start / start.sum(), inside / inside.sum(), move / move.sum(axis=1, keepdims=True), (emit / emit.sum(axis=0)).astype(np.float32))


def first_guess(vocab: Vocabulary, states: int, seed: int = 5) -> Model:
    """States that stay, each with the overall distribution disturbed by some noise."""
    r = np.random.default_rng(seed)
    emit = vocab.prior()[:, None] * r.gamma(1.0, size=(vocab.symbols, states))
    even = np.full(states, 1 / states)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(even, even, move, (emit / emit.sum(axis=0)).astype(np.float32))


def baum_welch(texts: DataFrame, vocab: Vocabulary, model: Model) -> tuple[Model, float]:
    """A better model after one pass over `texts` (seq), and the log likelihood of their segments under the present one."""
    states = len(model.start)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        emitted, moved, waiting = np.zeros((states, len(m.emit))).T, np.zeros((states + 3, states)), []

        def work(some: list) -> None:
            some.sort(key=lambda s: -len(s[0]))
            for a in range(0, len(some), SIDE):
                moved[:] += expected(m, [s for s, _ in some[a : a + SIDE]], np.array([f for _, f in some[a : a + SIDE]]), emitted)

        for batch in batches:
            for text in batch.column("seq"):
                seq = np.frombuffer(text.as_buffer(), np.uint16)
                waiting += [(seq[a : a + SEGMENT], a == 0) for a in range(0, len(seq), SEGMENT)]
                if len(waiting) >= 4 * SIDE:
                    work(waiting)
                    waiting = []
        if waiting:
            work(waiting)
        at = np.flatnonzero(emitted.any(axis=1))
        if len(at):
            values = np.vstack([moved, emitted[at]]).astype(np.float32)  # as precise as the recursions; the sums are doubles
            keys = np.concatenate([-1 - np.arange(len(moved)), at])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(v) for v in values.T.copy())], ["key", *(f"g{j}" for j in range(states))])

    names = [f"g{j}" for j in range(states)]
    sent = texts.select("seq").mapInArrow(counted_only(sums), "key int, " + ", ".join(f"{c} float" for c in names))
    # a row for each symbol; keys differ within a task, so there is nothing to sum up before the exchange
    total = sent.repartition("key").groupBy("key").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    emitted, moved = np.zeros(model.emit.shape), np.zeros((states + 3, states))
    key, values = total.column("key").to_numpy(), np.stack([total.column(c).to_numpy() for c in names], axis=1)
    emitted[key[key >= 0]], moved[-1 - key[key < 0]] = values[key >= 0], values[key < 0]
    return improved(vocab, moved, emitted), float(moved[-1].sum())


def _forward(model: Model, begin: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The state distribution at the end of each sequence and the logarithm of its likelihood, from the distribution that its first symbol is drawn with."""
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    now, log = np.array(begin)[order].astype(np.float64).T.copy(), np.zeros(len(parts))
    into, emit = model.move.T.copy(), np.ascontiguousarray(model.emit.T)
    run, at = _side_by_side([parts[i] for i in order])
    for a, b in zip(at, at[1:]):
        w = b - a
        some = (now[:, :w] if a == 0 else into @ now[:, :w]) * emit.take(run[a:b], axis=1)
        total = some.sum(axis=0)
        np.divide(some, total, out=now[:, :w])
        log[:w] += np.log(total)
    back = np.empty(len(parts), np.int64)
    back[order] = np.arange(len(parts))
    return now.T[back], log[back]


def likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each sequence of symbols; what is longer than BLOCK is cut into blocks, each begun from every state."""
    states, parts, begin, of = len(model.start), [], [], []
    for i, seq in enumerate(texts):
        for a in range(0, len(seq), BLOCK):
            for from_ in [model.start] if a == 0 else model.move:
                parts.append(seq[a : a + BLOCK])
                begin.append(from_)
                of.append(i)
    ends, logs = np.zeros((len(parts), states)), np.zeros(len(parts))
    for a in range(0, len(parts), SIDE):
        ends[a : a + SIDE], logs[a : a + SIDE] = _forward(model, begin[a : a + SIDE], parts[a : a + SIDE])
    result, at = np.zeros(len(texts)), 0
    for i, seq in enumerate(texts):
        state, log = ends[at], logs[at]
        at += 1
        for _ in range(BLOCK, len(seq), BLOCK):
            most = logs[at : at + states].max()
            state = (state * np.exp(logs[at : at + states] - most)) @ ends[at : at + states]
            log += most + np.log(state.sum())
            state = state / state.sum()
            at += states
        result[i] = log / np.log(10)
    return result


def fit(texts: DataFrame, vocab: Vocabulary, states: int, passes: int) -> Model:
    """The model of `texts` (seq) after so many passes over all of them; without a training text the untrained one."""
    model = first_guess(vocab, states)
    for _ in range(passes if vocab.texts else 0):
        model, _ = baum_welch(texts, vocab, model)
    return model


def score(
    docs: DataFrame,
    train: Column,
    keep: list[str],
    *,
    states: int = 8,
    own: int = 32_768,
    known: int = 262_144,
    endings: int = 4_096,
    start_passes: int = 12,
    passes: int = 2,
) -> DataFrame:
    """The columns `keep` of every row of docs, with n_tokens, n_known, train_tokens, base_score and score.

    train: the condition on docs that makes a row part of the training texts; null counts as false. A-Z count as lower case, the words of a
    text are followed by one end, which is a token too. base_score: sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens; n_known:
    tokens that occur in the training texts. score: log10 of the probability of the whole text under the hidden Markov model of the training texts,
    where a word never seen has the share 0.1 of its ending's symbol. Null texts are empty: one token, the end. Without training texts c, N and V are 0 and
    the model is the untrained one. Repeated rows are scored each. Columns of `keep` named like a result are replaced by it.
    `own`, `known` and `endings` bound what is broadcast (own + endings < 65,536). All `start_passes` + `passes` passes of Baum-Welch run over all training texts.
    """
    spark: SparkSession = docs.sparkSession
    shared_dir(spark)
    names, columns, types = kept(docs, keep, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    rows = docs.select(*columns, F.coalesce(train.cast("boolean"), F.lit(False)).alias("train"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    with batches_of(spark, 2048):
        counts = count_words(rows.where("train").select("text"), endings).checkpoint()
        texts = rows.where("train").count()
        vocab = vocabulary(counts, texts, own, known, endings)
        shared = spark.sparkContext.broadcast(vocab)
        kept_types = f"{types}, train boolean, row long" if types else "train boolean, row long"
        done = encoded(rows.select(*(f"k{i}" for i in range(len(names))), "train", "row", "text"), kept_types, "text", shared).checkpoint()
    model = spark.sparkContext.broadcast(fit(done.where("train").select("seq"), vocab, states, start_passes + passes))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = likelihoods(model.value, [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("seq")])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "seq"), pa.array(found)], [*(c for c in batch.schema.names if c != "seq"), "chain_log"])

    front = [*(f"k{i}" for i in range(len(names))), "row", "tokens", "known", "known_log", "share_log"]
    rest = "row long, tokens long, known long, known_log double, share_log double, chain_log double"
    judged = done.select(*front, "seq").mapInArrow(judge, f"{types}, {rest}" if types else rest)
    # words whose counts are not at hand: few of each text, joined by hash
    rare = done.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("hash"), F.col("w.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rare = rare.join(counts.select("hash", "n"), "hash", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + F.lit(ADD))).alias("rare_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    both = judged.join(rare, "row", "left").withColumn("rare_log", F.coalesce("rare_log", F.lit(0.0)))
    return both.select(
        *(F.col(f"k{i}").alias(n) for i, n in enumerate(names)), F.col("tokens").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + F.col("rare_log") - F.col("tokens") * float(np.log10(vocab.space))).alias("base_score"), (F.col("chain_log") + F.col("share_log") + F.col("rare_log")).alias("score"),
    )
