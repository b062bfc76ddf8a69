"""The trie of conversation prefixes, with subtree totals by leaf-peeling message passing.

* Turns become 128-bit hashes and word counts before anything moves; no text is shuffled.
* Positions and prefix hashes come from ordered passes: rows are sorted over all partitions, each partition sums up
  its first and last conversation (two rows, whatever it holds), and a second pass continues from what the partitions before
  it hold. So one conversation may fill many tasks.
* A prefix hash is a polynomial, so that the head of one conversation can be put before the tail of another
  without reading either again.
* Nodes with one member are complete at once: their subtree is one path that saves nothing. Each other node holds a
  counter of its remaining children; a completed node sends its totals to its parent, round by round. A node that waits
  for a single child follows it by pointer and adds up what it passes, and pointers double each round, so a path of thousands
  of turns takes a few rounds too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_dir

_U = np.uint64
#: Odd multipliers of the two halves of a prefix hash, and their inverses modulo 2^64.
BASES = tuple(_U(b) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
INVERSES = tuple(_U(pow(int(b), -1, 1 << 64)) for b in BASES)

#: Ids of one piece of a list of members.
PIECE = 4096


def powers(base: np.uint64, n: np.ndarray) -> np.ndarray:
    """base^n modulo 2^64."""
    n, out, base = n.astype(_U), np.ones(len(n), _U), np.array([base])
    for bit in range(int(n.max()).bit_length() if len(n) else 0):
        out = np.where(n >> _U(bit) & _U(1), out * base, out)
        base = base * base
    return out


class Run:
    """What is known of a conversation up to some turn: how many turns, and the halves of their prefix hash."""

    def __init__(self, conv: int | None = None, n: int = 0, key: tuple[int, ...] = (0, 0)):
        self.conv, self.n, self.key = conv, n, key

    def then(self, more: Run) -> Run:
        """This and `more`, hashed as if it stood alone, of the same conversation."""
        shift = (pow(int(b), self.n, 1 << 64) for b in BASES)
        return Run(self.conv, self.n + more.n, tuple((k + s * m) % (1 << 64) for k, s, m in zip(self.key, shift, more.key, strict=True)))


def _halves(h: pa.Array) -> np.ndarray:
    """The rows of a column of 16 bytes as two columns of 64 bits."""
    data = b"".join(h.to_pylist())
    return np.frombuffer(data, ">u8").reshape(-1, 2).astype(_U)


def _follow(run: Run, conv: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], Run]:
    """Position, prefix hash with and without the turn itself of each row, going on from `run`; and what then is known of the last conversation."""
    first = np.append(True, conv[1:] != conv[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(conv)), 0))
    goes_on = (start == 0) & (conv[0] == (run.conv if run.conv is not None else conv[0] - 1))
    pos = np.arange(len(conv)) - start + 1 + np.where(goes_on, run.n, 0)
    with_, without = [], []
    for half in range(2):
        term = halves[:, half] * powers(BASES[half], pos)
        total = np.cumsum(term, dtype=_U)
        before = total - term
        key = total - before[start] + np.where(goes_on, _U(run.key[half]), _U(0))
        with_.append(key)
        without.append(key - term)
    return pos, with_, without, Run(int(conv[-1]), int(pos[-1]), tuple(int(k[-1]) for k in with_))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x, pa.int64())


def ordered(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), words, and the prefix hash (a, b) with and (pa, pb) without each turn, of turns (conv, turn, h, words).

    Turns are ordered by `turn`, null first, and where it is equal by h.
    """
    spark = turns.sparkSession
    keys = ["conv", "turn", "h"]
    table = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).checkpoint()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, run, part = None, Run(), 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                conv, halves = batch.column("conv").to_numpy(), _halves(batch.column("h"))
                if first is None or first.conv == run.conv == conv[0]:  # the first conversation goes on
                    same = int((np.cumsum(conv != conv[0]) == 0).sum())
                    first = _follow(run, conv[:same], halves[:same])[3]
                run = _follow(run, conv, halves)[3]
        if first is not None:
            both = [first, run]
            numbers = [[part] * 2, [r.conv for r in both], [r.n for r in both]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), *(_long(np.array([r.key[i] for r in both], _U)) for i in range(2))], ["part", "conv", "n", "a", "b"])

    known: dict[int, list[Run]] = {}
    for r in table.select("part", "conv", "h").mapInArrow(ends, "part long, conv long, n long, a long, b long").collect():  # two rows of each partition
        known.setdefault(r["part"], []).append(Run(r["conv"], r["n"], (r["a"] % (1 << 64), r["b"] % (1 << 64))))
    carried, before = {}, Run()
    for part, (first, last) in sorted(known.items()):
        if before.conv == first.conv:
            carried[part] = before
            before = before.then(first) if first.conv == last.conv else last
        else:
            before = last
    shared = spark.sparkContext.broadcast(carried)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for batch in batches:
            if batch.num_rows:
                run = run or shared.value.get(batch.column("part")[0].as_py(), Run())
                pos, with_, without, run = _follow(run, batch.column("conv").to_numpy(), _halves(batch.column("h")))
                yield pa.RecordBatch.from_arrays([batch.column("conv"), _long(pos), batch.column("words"), *map(_long, (*with_, *without))], ["conv", "pos", "words", "a", "b", "pa", "pb"])

    return table.select("part", "conv", "h", "words").mapInArrow(number, "conv long, pos long, words long, a long, b long, pa long, pb long")


def _moved(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Prefix hashes `pairs` of rows behind the first `cut` turns of their own conversation, as if the `head` turns of hash (fa, fb) stood there instead; (ca, cb) is the hash of what is cut."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                short = batch.column("cut").to_numpy() - batch.column("head").to_numpy()
                for half in range(2):
                    less = powers(INVERSES[half], short)
                    front, gone = (batch.column(f"{x}{'ab'[half]}").to_numpy().view(_U) for x in "fc")
                    for pair in pairs:
                        at = batch.schema.names.index(pair[half])
                        batch = batch.set_column(at, pair[half], _long(front + less * (batch.column(at).to_numpy().view(_U) - gone)))
                yield batch

    return rows.mapInArrow(move, rows.schema)


def rebuilt(own: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (conv, depth, words, a, b, pa, pb, last) of all conversations rebuilt, and each one's last node (conv, depth, a, b).

    Conversation `conv` keeps what follows its first `heads` turns (at most `most`), behind as many first turns of the conversation `base`.
    The root, depth 0 with hash (0, 0), is a row of each conversation too.
    """
    firsts = [F.max(F.when(F.col("pos") == i, F.struct("a", "b", "words"))).alias(f"first{i}") for i in range(1, most + 1)]
    convs = own.groupBy("conv").agg(F.max("pos").alias("n"), F.max_by(F.struct("a", "b"), "pos").alias("end"), *firsts)
    convs = convs.select("conv", "n", "end", F.array(*(F.col(f"first{i}") for i in range(1, most + 1))).alias("firsts")).checkpoint()
    named = convs.withColumn("base", base).withColumn("cut", heads.cast("long"))
    of_base = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("firsts").alias("base_firsts"))
    info = named.join(of_base, "base", "left").withColumn("head", F.least("cut", F.coalesce("base_n", F.lit(0))))

    def half(firsts: str, n: str, x: str) -> Column:
        return F.when(F.col(n) > 0, F.element_at(F.col(firsts), F.greatest(F.col(n), F.lit(1)).cast("int"))[x]).otherwise(F.lit(0).cast("long"))

    info = info.select(
        "conv", "cut", "head", "n", "end", F.slice("base_firsts", F.lit(1), F.col("head").cast("int")).alias("front"),
        *(F.coalesce(half("base_firsts", "head", x), F.lit(0).cast("long")).alias(f"f{x}") for x in "ab"),
        *(F.coalesce(half("firsts", "cut", x), F.lit(0).cast("long")).alias(f"c{x}") for x in "ab"),
    ).checkpoint()
    length = F.col("head") + F.greatest(F.col("n") - F.col("cut"), F.lit(0))
    names = ["conv", "depth", "words", "a", "b", "pa", "pb", "last"]
    tail = own.join(info.drop("front", "end"), "conv").where("pos > cut").withColumn("depth", F.col("head") + F.col("pos") - F.col("cut")).withColumn("last", F.col("pos") == F.col("n"))
    tail = _moved(tail.select(*names, "cut", "head", "fa", "fb", "ca", "cb"), [("a", "b"), ("pa", "pb")]).select(*names)
    zero = F.lit(0).cast("long")
    root = info.select("conv", zero.alias("depth"), zero.alias("words"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), (length == 0).alias("last"))
    front = info.where("head > 0").select("conv", length.alias("length"), "front", F.posexplode("front").alias("at", "own"))
    earlier = [F.when(F.col("at") > 0, F.element_at("front", F.greatest(F.col("at"), F.lit(1)))[x]).otherwise(zero).alias(f"p{x}") for x in "ab"]
    front = front.select("conv", (F.col("at") + 1).cast("long").alias("depth"), "own.words", "own.a", "own.b", *earlier, (F.col("at") + 1 == F.col("length")).alias("last"))
    ends = info.where("n > cut").select("conv", length.alias("depth"), "end.a", "end.b", "cut", "head", "fa", "fb", "ca", "cb")
    ends = _moved(ends, [("a", "b")]).select("conv", "depth", "a", "b").unionByName(info.where("n <= cut").select("conv", length.alias("depth"), F.col("fa").alias("a"), F.col("fb").alias("b")))
    return tail.unionByName(root).unionByName(front), ends


def peel(state: DataFrame, rounds: int = 200) -> DataFrame:
    """conv_id, depth, leaves, saved: totals of whole subtrees.

    state: nodes (conv_id, depth, parent) with `left`, the number of children that are nodes of the table, `rest`, the exclusive or
    of those children's conv_id, and the leaves and savings outside of them.
    """
    status = F.when(F.col("left") == 0, 2).when(F.col("left") == 1, 1).otherwise(0)
    now = state.select("conv_id", "depth", "parent", "left", "rest", "leaves", "saved", status.alias("status"), F.lit(0).alias("since"), F.col("rest").alias("wait"), (F.col("depth") + 1).alias("wait_depth")).checkpoint()
    for turn in range(rounds):
        if not now.where("status < 2").limit(1).count():
            return now.select("conv_id", "depth", "leaves", "saved")
        sent = now.where((F.col("status") == 2) & (F.col("since") == turn))
        sent = sent.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("m"), F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"), F.bit_xor("conv_id").alias("m_rest"))
        branch = now.where("status = 0").join(sent, ["conv_id", "depth"], "left")
        left, rest = F.col("left") - F.coalesce("m", F.lit(0)), F.col("rest").bitwiseXOR(F.coalesce("m_rest", F.lit(0)))
        branch = branch.select(
            "conv_id", "depth", "parent", left.alias("left"), rest.alias("rest"), (F.col("leaves") + F.coalesce("m_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("m_saved", F.lit(0))).alias("saved"),
            F.when(left == 0, 2).when(left == 1, 1).otherwise(0).alias("status"), F.lit(turn + 1).alias("since"), rest.alias("wait"), (F.col("depth") + 1).alias("wait_depth"),
        )
        ahead = now.select(F.col("conv_id").alias("wait"), F.col("depth").alias("wait_depth"), *(F.col(c).alias(f"w_{c}") for c in ("status", "leaves", "saved", "wait", "wait_depth")))
        moves = F.col("w_status") > 0
        single = now.where("status = 1").join(ahead, ["wait", "wait_depth"])
        single = single.select(
            "conv_id", "depth", "parent", "left", "rest", *((F.col(c) + F.when(moves, F.col(f"w_{c}")).otherwise(0)).alias(c) for c in ("leaves", "saved")),
            F.when(F.col("w_status") == 2, 2).otherwise(1).alias("status"), F.lit(turn + 1).alias("since"), *(F.when(F.col("w_status") == 1, F.col(f"w_{c}")).otherwise(F.col(c)).alias(c) for c in ("wait", "wait_depth")),
        )
        now = now.where("status = 2").unionByName(branch).unionByName(single).checkpoint()
    raise RuntimeError(f"subtrees were not complete after {rounds} rounds")


def digests(members: DataFrame) -> DataFrame:
    """conv_id, depth, sha: of members (conv_id, depth, conv) the hash of each node's members in ascending order, joined by commas.

    Members are sorted over all partitions and joined there into pieces, which stream through the hash of their node: no list is held whole.
    """
    keys = ["conv_id", "depth", "conv"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, depth, conv = (batch.column(c).to_numpy() for c in keys)
                new = np.append(True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1]))
                start = np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))
                cut = np.flatnonzero((np.arange(len(node)) - start) % PIECE == 0)
                joined = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cut, np.append(cut[1:], len(node)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[cut], depth[cut], conv[cut], joined)], [*keys, "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, hashlib.sha256(), []
        for batch in batches:
            for node, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "piece")), strict=True):
                if (node, depth) == at:
                    state.update(b",")
                else:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (node, depth), hashlib.sha256()
                state.update(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["conv_id", "depth", "sha"])
                done = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], ["conv_id", "depth", "sha"])

    cut = members.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pieces, "conv_id long, depth long, conv long, piece string")
    return cut.repartition("conv_id", "depth").sortWithinPartitions(*keys).mapInArrow(hashed, "conv_id long, depth long, sha string")


def prefix_trie(conversations: DataFrame, base: Column, heads: Column, most: int, *, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """A row for each distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    base, heads: on the column `conv`, the conversation whose first `heads` turns (0 to `most`) stand before what follows the first `heads`
    turns of `conv` itself; fewer, where it has fewer, none where it is absent. A null role or text counts as empty; a null turn comes first,
    turns of equal number are ordered by a hash of role and text. Rows without a conversation are left out; repeated rows are turns of their own.
    A conversation without turns after rebuilding ends at the root. Without conversations there is no row. Other columns do not matter.
    """
    spark = conversations.sparkSession
    shared_dir(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    turns = conversations.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("conv"), F.col(turn_column).alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("h"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows, ends = rebuilt(ordered(turns), base, heads, most)
    nodes = rows.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv"))).alias("one_end"),
        F.max("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
    ).checkpoint()
    shared = nodes.where("n_convs > 1").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("owner"))
    placed = nodes.where("depth > 0").join(shared, ["depth", "pa", "pb"], "left").withColumn("parent_conv_id", F.coalesce("owner", "conv_id")).drop("pa", "pb")
    placed = placed.unionByName(nodes.where("depth = 0").select(*nodes.columns).drop("pa", "pb").withColumn("owner", F.lit(None).cast("long")).withColumn("parent_conv_id", F.lit(None).cast("long"))).checkpoint()

    several = F.col("n_convs") > 1
    children = placed.where("owner IS NOT NULL").groupBy(F.col("owner").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"), F.count_if(several).alias("left"), F.bit_xor(F.when(several, F.col("conv_id")).otherwise(0)).alias("rest"))
    waiting = placed.where(several).join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children", "left", "rest"])
    waiting = waiting.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaves", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_children") - F.col("left"))).withColumn("parent", F.col("parent_conv_id")).checkpoint()
    totals = peel(waiting).select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    many = nodes.where("n_ends > 1").select("depth", "a", "b", "conv_id")
    listed = digests(ends.join(many, ["depth", "a", "b"]).select("conv_id", "depth", "conv"))
    sha = F.when(F.col("n_ends") > 1, F.col("sha")).otherwise(F.sha2(F.encode(F.coalesce(F.col("one_end").cast("string"), F.lit("")), "utf-8"), 256)).alias("ends_sha256")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    common = waiting.join(totals, ["conv_id", "depth"]).join(listed, ["conv_id", "depth"], "left").select(*names[:6], names[6], sha)
    one = F.lit(1).cast("long")
    alone = placed.where(~several).select(*names[:4], (1 - F.col("n_ends")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.lit(None).cast("string").alias("sha"), "n_ends", "one_end")
    return common.unionByName(alone.select(*names, sha))
