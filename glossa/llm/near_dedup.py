"""MinHash near-duplicate detection by a chosen-path set similarity join.

A document is its set of distinct k-word shingles. Equal sets form one class.
Every tree starts with all classes in its root. A node branches on 1 / s minwise
tokens on average (s: the threshold), which the path to the node selects; the
classes that agree on such a token meet in a child. A node of at most
``node_limit`` classes is a leaf and compared exhaustively: first by sketches,
then candidates on their full sets. A larger node right below a root is dealt
into blocks, and each block is compared together with the node's pivots, a few
dozen of its classes; this links a large group of near copies through its pivots
by rows in proportion to its size. Then the node branches.

The links that a first few trees find become components before the other trees
start, and theirs before anything branches further. A node whose classes all lie
in one component has nothing left to find and is dropped. One of which all but a
few classes do is not branched either: these few are compared with all others,
block by block, by rows in proportion to its size. So a large group of copies
costs a tree one comparison, and only groups of texts that are alike but not
linked go through many branchings.

A pair at the threshold meets in the leaves of a tree with a probability that
``survival`` gives; the number of trees follows from it and the target recall.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.hashing import Words, shingle_set
from glossa.llm.shared import Workspace, among, hash_bits, slices
from glossa.operators.components import components

PERMUTATIONS = 64
#: Branchings that the target recall allows for.
DEPTH = 4
#: Trees that go first, so that most copies are linked before the others start.
PILOT = 3
#: Classes of a large node that every block of it is compared with, on average.
PIVOTS = 32

_SKETCH = "doc_id long, n_shingles long, cid binary, sig array<int>"


def _permutations() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


#: What parts words: space and \x09-\x0D.
SEPARATORS = b" \t\n\x0b\x0c\r"


def survival(threshold: float, depth: int = DEPTH) -> float:
    """The probability that a pair at the threshold is still together in some node after ``depth`` branchings of a tree."""
    base, more = divmod(1 / threshold, 1)
    p = 1.0
    for _ in range(depth):
        lost = 1 - threshold * p
        p = 1 - lost**base * (1 - more + more * lost)
    return p


def trees_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    lost = 1 - survival(threshold, depth)
    trees = math.ceil(math.log(1 - recall) / math.log(lost)) if lost > 0 else 1
    if trees > PERMUTATIONS:
        raise ValueError(f"a recall of {recall} at {threshold} needs {trees} trees, more than {PERMUTATIONS} minwise tokens can start")
    return trees


def minwise(s: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """The least 32 high bits of a set's values under each permutation."""
    low = np.full(len(perms), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(low, np.multiply.outer(perms, s[at : at + 1024]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, perms = Words(SEPARATORS), _permutations()
        for batch in slices(batches):
            rows: tuple[list, list, list] = ([], [], [])
            for text in batch.column("text").to_pylist():
                s = shingle_set(words(text), k)
                rows[0].append(len(s))
                rows[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                rows[2].append(minwise(s, perms) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "cid", "sig"],
            )

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from rows that are sorted by ``key``; one frame may hold many groups."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        last = frame[key].iloc[-1]
        cut = int(np.searchsorted(frame[key].to_numpy(), last))
        if cut or (kept and kept[-1][key].iloc[-1] != last):
            yield pd.concat([*kept, frame.iloc[:cut]]) if kept else frame.iloc[:cut]
            kept = []
        kept.append(frame.iloc[cut:])
    if kept:
        yield pd.concat(kept)


class _Frame:
    """The columns of whole groups as arrays; components are numbered within the frame."""

    def __init__(self, frame: pd.DataFrame):
        self.node, self.cid, self.n = frame["node"].to_numpy(), frame["cid"].to_numpy(), frame["n"].to_numpy()
        self.comp, self.comps = pd.factorize(frame["comp"])
        self.sig = np.stack(frame["sig"].to_list())
        self.leaves = frame["leaves"].to_list()
        self.shingles = frame["shingles"].to_numpy() if "shingles" in frame else None

    def groups(self) -> Iterator[slice]:
        starts = np.flatnonzero(np.r_[True, self.node[1:] != self.node[:-1]])
        for a, b in zip(starts, [*starts[1:], len(self.node)], strict=True):
            if b - a > 1:
                yield slice(int(a), int(b))

    def candidates(self, g: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i < j, from the group's start) that may be linked and whose components differ.

        A pair is left to the first of the leaves that both ends are in, so that
        no two trees do the same work.
        """
        sig, n, comp = self.sig[g], self.n[g], self.comp[g]
        margin = PERMUTATIONS * (threshold - 5.5 * math.sqrt(threshold * (1 - threshold) / PERMUTATIONS))
        step = max(1, (1 << 20) // (len(n) * PERMUTATIONS))
        is_, js_ = [], []
        for at in range(0, len(n), step):
            rows = slice(at, at + step)
            ok = np.minimum(n[rows, None], n) >= (threshold - 1e-9) * np.maximum(n[rows, None], n)
            ok &= comp[rows, None] != comp
            ok &= np.arange(len(n)) > np.arange(len(n))[rows, None]
            if ok.any():
                ok &= (sig[rows, None, :] == sig).sum(2) >= margin
                i, j = np.nonzero(ok)
                is_.append(i + at)
                js_.append(j)
        if not is_:
            return np.empty(0, int), np.empty(0, int)
        i, j = np.concatenate(is_), np.concatenate(js_)
        own = ~self._shared_before(g, i, j)
        return i[own], j[own]

    def _shared_before(self, g: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs share a leaf with a lower number than the group's, by a bit for each leaf that several members are in."""
        lower = [x[x < self.node[g.start]] for x in self.leaves[g]]
        values, inverse, counts = np.unique(np.concatenate(lower), return_inverse=True, return_counts=True)
        number = np.cumsum(counts > 1) - 1
        if not len(values) or number[-1] < 0:
            return np.zeros(len(i), bool)
        bits = np.zeros((len(lower), (int(number[-1]) // 64 + 1) * 64), bool)
        keep = (counts > 1)[inverse]
        bits[np.repeat(np.arange(len(lower)), [len(x) for x in lower])[keep], number[inverse[keep]]] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        return np.concatenate([(packed[i[a : a + 65536]] & packed[j[a : a + 65536]]).any(1) for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)


_MEMBER = "node long, cid binary, comp binary, n long, sig array<tinyint>, leaves array<bigint>"


def _with_candidates(threshold: float):
    """Rows of nodes -> those of the classes that have a candidate in that node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _grouped(batches, "node"):
            frame, rows = _Frame(whole), []
            for g in frame.groups():
                i, j = frame.candidates(g, threshold)
                if len(i):
                    rows.append(np.union1d(i, j) + g.start)
            if rows:
                busy = whole.iloc[np.concatenate(rows)]
                yield pa.RecordBatch.from_pandas(busy, pa.schema([("node", pa.int64()), ("cid", pa.binary()), ("comp", pa.binary()), ("n", pa.int64()), ("sig", pa.list_(pa.int8())), ("leaves", pa.list_(pa.int64()))]), preserve_index=False)

    return run


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Intersection sizes of the pairs, by bit rows over the shingles that two sets or more share."""
    if len(i) <= 4:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = shared[inverse]
    owner, column = owner[keep], number[inverse[keep]]
    total = np.zeros(len(i), np.int64)
    width = 1 << 15
    for at in range(0, int(shared.sum()), width):
        here = (column >= at) & (column < at + width)
        bits = np.zeros((len(sets), width), bool)
        bits[owner[here], column[here] - at] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for a in range(0, len(i), 4096):
            b = slice(a, a + 4096)
            total[b] += np.bitwise_count(packed[i[b]] & packed[j[b]]).sum(1, dtype=np.int64)
    return total


def _forest(frame: _Frame, g: slice, threshold_pct: int) -> Iterator[tuple[int, int]]:
    """Confirmed pairs of a node's components, in the frame's numbers: no pair that earlier ones already connect.

    The members with the most candidates are compared first, as each of them
    may connect many at once; what they leave is compared in one go.
    """
    i, j = frame.candidates(g, threshold_pct / 100)
    if not len(i):
        return
    n, comp = frame.n[g], frame.comp[g].copy()
    sets = [np.frombuffer(x, np.uint64) for x in frame.shingles[g]]
    first = np.argsort(-np.bincount(np.r_[i, j], minlength=len(n)), kind="stable")[:4]
    done = np.zeros(len(i), bool)
    for p in [*first, -1]:
        open_ = ~done & (comp[i] != comp[j])
        if p >= 0:
            open_ &= (i == p) | (j == p)
        done |= open_
        a, b = i[open_], j[open_]
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            inter = _intersections(sets, a[part], b[part])
            linked = 100 * inter >= threshold_pct * (n[a[part]] + n[b[part]] - inter)
            for x, y in zip(a[part][linked].tolist(), b[part][linked].tolist(), strict=True):
                if comp[x] != comp[y]:
                    yield int(comp[x]), int(comp[y])
                    comp[comp == comp[y]] = comp[x]


def _links(threshold_pct: int):
    """Rows of nodes with full sets -> confirmed links between components, one spanning forest for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _grouped(batches, "node"):
            frame = _Frame(whole)
            found = [pair for g in frame.groups() for pair in _forest(frame, g, threshold_pct)]
            yield pa.RecordBatch.from_arrays([pa.array([frame.comps[x[k]] for x in found], pa.binary()) for k in (0, 1)], ["u", "v"])

    return run


def _sets_of(k: int, bits):
    """(doc_id, hash, text) -> full shingle sets of the documents whose hash may be among those of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, have = Words(SEPARATORS), bits.value
        for batch in slices(batches):
            rows = np.flatnonzero(among(have, batch.column("hash").to_numpy()))
            if not len(rows):
                continue
            cids, sets = [], []
            for text in batch.column("text").take(pa.array(rows)).to_pylist():
                raw = shingle_set(words(text), k).tobytes()
                cids.append(hashlib.blake2b(raw, digest_size=16).digest())
                sets.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(cids, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "cid", "shingles"])

    return run


def _short(sig: str) -> Column:
    """A byte of each minwise token: enough to compare by, as unequal tokens seem equal once in 256 times and no equal ones are missed."""
    return F.transform(sig, lambda x: (x.bitwiseAND(255) - 128).cast("tinyint"))


def _roots(known: DataFrame, trees: range, threshold: float) -> DataFrame:
    """(cid, comp, key, slot, stride, turn): the children of the trees' roots; as far as there are enough, no two of them branch on the same token.

    A path goes on from its first token by a stride that its key selects: odd,
    so that it meets each of the tokens once.
    """
    each = 1 / threshold
    children = []
    for t in trees:
        for slot in range(int(t * each), int((t + 1) * each)):
            children.append(F.struct(F.xxhash64(F.lit(t), F.lit(slot), F.col("sig")[slot % PERMUTATIONS]).alias("key"), F.lit(slot % PERMUTATIONS).alias("slot")))
    rows = known.select("cid", "comp", F.explode(F.array(*children)).alias("child")).select("cid", "comp", "child.*")
    stride = (F.pmod(F.xxhash64("key", F.lit("stride")), F.lit(PERMUTATIONS // 2)) * 2 + 1).cast("int")
    return rows.select("cid", "comp", "key", "slot", stride.alias("stride"), F.lit(0).alias("turn"))


#: Branchings of a large node that are made at once, at most: the nodes in between aren't looked at.
LEAP = 3
#: Classes of a large node, on average, that tell how alike its classes are.
PROBES = 48


def _alike(large: DataFrame, known: DataFrame) -> DataFrame:
    """(key, alike): the mean share of minwise tokens that two classes of a large node have in common, by PROBES of its classes."""

    def run(probes: pd.DataFrame) -> pd.DataFrame:
        sig = np.stack(probes["sig"].to_list())
        pairs = len(sig) * (len(sig) - 1)
        same = sum(int((np.unique(column, return_counts=True)[1] ** 2).sum()) for column in sig.T) / PERMUTATIONS - len(sig)
        return pd.DataFrame({"key": probes["key"].iloc[:1].to_numpy(), "alike": [same / pairs if pairs else 0.0]})

    probes = large.filter(F.pmod(F.xxhash64(F.lit("probe"), "cid", "key"), F.col("size")) < PROBES).select("cid", "key")
    return probes.join(known.select("cid", "sig"), "cid").groupBy("key").applyInPandas(run, "key long, alike double")


def _branched(large: DataFrame, known: DataFrame, threshold: float, node_limit: int) -> DataFrame:
    """Rows of large nodes with their size -> those of their children.

    A node has 1 / threshold children on average: the whole part of it, and one
    more if its key says so. A node that will still be large after several
    branchings goes through them at once: as many as bring texts that are as
    alike as its own down to the limit, LEAP at most. A path that has used all
    tokens ends.
    """
    base, more = divmod(1 / threshold, 1)
    last = PERMUTATIONS - 1 - int(base)

    def children(node: Column) -> Column:
        key, slot, stride, turn, steps = (node[x] for x in ("key", "slot", "stride", "turn", "steps"))
        count = F.lit(int(base)) + F.when(F.pmod(F.xxhash64(key, F.lit("more")), F.lit(1 << 20)) < int(more * (1 << 20)), 1).otherwise(0)

        def made(key: Column, turn: Column, steps: Column) -> Column:
            return F.struct(key.alias("key"), slot.alias("slot"), stride.alias("stride"), turn.alias("turn"), steps.alias("steps"))

        def child(branch: Column) -> Column:
            at = F.pmod(slot + stride * (turn + branch), F.lit(PERMUTATIONS))
            return made(F.xxhash64(key, at, F.get("sig", at)), turn + count, steps - 1)

        return F.when((turn < last) & (steps > 0), F.transform(F.sequence(F.lit(1), count), child)).otherwise(F.array(made(key, turn, steps)))

    share = F.least(F.greatest(F.coalesce("alike", F.lit(0.0)), F.lit(0.01)), F.lit(min(threshold, 0.99)))
    steps = F.least(F.floor(F.log(F.col("size") / node_limit) / -F.log(share)) + 1, F.lit(LEAP)).cast("int")
    rows = large.filter(F.col("turn") < last).join(_alike(large, known), "key", "left").withColumn("steps", steps)
    # the members of a large node lie together where it was met: dealt anew, they branch in all tasks, a class with its tokens once for all its nodes
    each = rows.repartition("cid").groupBy("cid").agg(F.collect_list(F.struct("key", "slot", "stride", "turn", "steps")).alias("nodes"))
    each = each.join(known.select("cid", "comp", "sig"), "cid")
    for _ in range(LEAP):
        each = each.withColumn("nodes", F.flatten(F.transform("nodes", children)))
    return each.select("cid", "comp", F.explode("nodes").alias("child")).select("cid", "comp", "child.key", "child.slot", "child.stride", "child.turn")


def _blocks(rows: DataFrame, node_limit: int, pivot: Column, others: Column) -> DataFrame:
    """Rows of nodes with their key and size -> with ``node``, the leaf or block to compare them in.

    A node above the limit is dealt into blocks for ``others`` classes, half the
    limit each; those that are ``pivot`` go to every block. Block numbers of a
    pivot are made in two steps, so that no row holds more of them than the
    square root of their number.
    """
    large, half = F.col("size") > node_limit, max(1, node_limit // 2)
    count = F.when(large, F.ceil(others / half)).otherwise(1).cast("long")
    side = F.ceil(F.sqrt("count")).cast("long")
    one = F.array(F.lit(-1).cast("long"))
    rows = rows.withColumn("pivot", large & pivot).withColumn("count", count)
    rows = rows.withColumn("high", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0).cast("long"), side - 1)).otherwise(one)))
    rows = rows.withColumn("low", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0).cast("long"), side - 1)).otherwise(one)))
    block = F.when(F.col("pivot"), F.col("high") * side + F.col("low")).otherwise(F.pmod(F.xxhash64("cid", "key"), F.col("count")))
    rows = rows.withColumn("block", block).filter("block < count")
    return rows.withColumn("node", F.when(large, F.xxhash64("key", "block")).otherwise(F.col("key")))


def _sampled(node_limit: int) -> Column:
    """Whether a class is one of its node's PIVOTS, by its hash."""
    return F.pmod(F.xxhash64(F.lit("pivot"), "cid", "key"), F.col("size")) < min(PIVOTS, max(1, node_limit // 2))


#: What ``settled`` asks of a node: its classes, those of its main component, that component, and whether few are beside it.
_STATE = ("size", "most", "main", "few")


def _that_may_meet(level: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of a level whose key may be among those of ``sizes``, by a bit for each key.

    Most rows of the children of roots are alone in their node. They are told
    by a filter of one size for any input, and not dealt out to be told.
    """
    held = hash_bits(sizes.select("key"), "key").view(np.int64)
    bits = level.sparkSession.createDataFrame(pa.table({"bits": pa.array([held], pa.list_(pa.int64()))}))
    bit = F.pmod("key", F.lit(64 * len(held)))
    word = F.get("bits", F.floor(bit / 64).cast("int"))
    return level.join(F.broadcast(bits), F.call_function("getbit", word, F.pmod(bit, F.lit(64)).cast("int")) == 1).drop("bits")


class _Join:
    """One run of the join: the classes with their components so far, and the members of nodes that wait for their full sets."""

    def __init__(self, source: DataFrame, classes: DataFrame, work: Workspace, k: int, threshold_pct: int, node_limit: int):
        self.source, self.classes, self.work = source, classes, work
        self.k, self.pct, self.node_limit = k, threshold_pct, node_limit
        self.known = classes.withColumn("comp", F.col("cid"))
        self.label: DataFrame | None = None
        self.busy: list[DataFrame] = []
        self.level = self.confirmed = 0

    def _at_nodes(self, rows: DataFrame) -> DataFrame:
        return rows.repartition("node").sortWithinPartitions("node", "cid")

    def compare(self, level: DataFrame, pivots: bool) -> DataFrame | None:
        """Look for candidates in the nodes of a level, and give its large nodes, None if there are none.

        Large nodes are compared with their pivots, or only branched: further
        down a pivot could tell nothing new before the last components are known.
        There ``settled`` comes without new components in between, so that what
        it asks of a node is told with the node's size.
        """
        self.level += 1
        if pivots:
            hashed = F.xxhash64("comp")  # a number can be aggregated without a sort
            sizes = level.groupBy("key").agg(F.count("*").alias("size"), F.min(hashed).alias("low"), F.max(hashed).alias("high"))
            sizes = sizes.filter("low <> high").select("key", "size")
        else:
            sizes = self._state(level)
        # written: the join's shuffles are then its own, and a node of very many classes is split
        sizes = self.work.table(sizes, f"sizes{self.level}")
        if pivots:
            level = _that_may_meet(level, sizes)
        met = self.work.table(level.join(sizes, "key").select("cid", "slot", "stride", "turn", *[sizes[c] for c in sizes.columns]), f"met{self.level}")
        # a class is in as many nodes of a level as there are branches of all trees at most
        nodes = met.groupBy("cid").agg(F.collect_list(F.struct("key", "size")).alias("nodes")).join(self.known.select("cid", "comp", "n", _short("sig").alias("sig")), "cid")
        small = F.filter("nodes", lambda x: x["size"] <= self.node_limit)
        nodes = nodes.withColumn("leaves", F.array_sort(F.transform(small, lambda x: x["key"]))).withColumn("in", F.explode("nodes" if pivots else small))
        self._look(_blocks(nodes.select("cid", "comp", "n", "sig", "leaves", "in.*"), self.node_limit, _sampled(self.node_limit), F.col("size")), f"busy{self.level}")
        large = met.filter(F.col("size") > self.node_limit)
        return None if large.isEmpty() else large

    def _look(self, dealt: DataFrame, name: str) -> None:
        """Compare the classes of each node by their sketches; those with candidates wait for their full sets."""
        # of a class's other leaves only lower ones are asked for
        rows = dealt.select("node", "cid", "comp", "n", "sig", F.filter("leaves", lambda x: x < F.col("node")).alias("leaves"))
        self.busy.append(self.work.table(self._at_nodes(rows).mapInArrow(_with_candidates(self.pct / 100), _MEMBER), name))

    def _state(self, rows: DataFrame) -> DataFrame:
        """(key, size, most, main, few) of the nodes of rows (key, comp) that no component has for itself."""
        each = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
        state = each.groupBy("key").agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("comp", "c").alias("main"))
        return state.filter("most < size").withColumn("few", F.col("size") - F.col("most") <= max(1, self.node_limit // 2))

    def settled(self, large: DataFrame, last: bool) -> DataFrame | None:
        """The children of those of the large nodes that must branch, by the components as they are known now.

        A node within one component is dropped. One of which all but half a
        node's classes lie in one component is compared: these classes go to
        every block of the others, so that no pair that could join two
        components is left. ``last``: no classes but these will be asked for.
        """
        # one row for each class, which gets its component and its tokens once for all its nodes
        known = "few" in large.columns
        kept = ["key", "slot", "stride", "turn", *(_STATE if known else ())]
        placed = large.groupBy("cid").agg(F.collect_list(F.struct(*kept)).alias("nodes")).join(self.known.select("cid", "comp", "n", "sig"), "cid")
        placed = self.work.table(placed, f"placed{self.level}")
        if last:
            self.known = placed.drop("nodes")
        rows = placed.select("cid", "comp", "n", "sig", F.explode("nodes").alias("node")).select("cid", "comp", "n", _short("sig").alias("sig"), "node.*")
        state = large
        if not known:
            state = self.work.table(self._state(placed.select("comp", F.explode("nodes.key").alias("key"))), f"state{self.level}")
        told = state.agg(F.count(F.when(F.col("few"), 1)), F.count(F.when(~F.col("few"), 1))).first()
        if not told[0] and not told[1]:
            return None
        rows = rows if known else rows.join(state, "key")
        rows = self.work.table(rows.withColumn("sig", F.when(F.col("few"), F.col("sig"))), f"open{self.level}")
        if told[0]:
            found = rows.filter("few").withColumn("leaves", F.array().cast("array<bigint>"))
            self._look(_blocks(found, self.node_limit, F.col("comp") != F.col("main"), F.col("most")), f"settled{self.level}")
        if not told[1]:
            return None
        branching = rows.filter("not few").select("cid", "key", "slot", "stride", "turn", "size")
        # written: a level is read twice, its branching is done once
        return self.work.table(_branched(branching, placed.select("cid", "comp", "sig"), self.pct / 100, self.node_limit), f"branched{self.level}")

    def _sets(self, cids: DataFrame) -> DataFrame:
        """(cid, shingles) of some classes, from the texts of the documents that stand for them."""
        needed = self.work.table(cids.distinct().join(self.classes.select("cid", "rep"), "cid"), f"needed{self.confirmed}")
        bits = self.source.sparkSession.sparkContext.broadcast(hash_bits(needed.select(F.xxhash64("rep").alias("hash")), "hash"))
        found = self.source.withColumn("hash", F.xxhash64("doc_id")).mapInArrow(_sets_of(self.k, bits), "doc_id long, cid binary, shingles binary")
        return found.join(needed, "cid").filter(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["cid"]).select("cid", "shingles")

    def confirm(self) -> None:
        """Compare the waiting candidates on their full sets, and bring the links into the components."""
        self.confirmed += 1
        busy, self.busy = reduce(DataFrame.unionByName, self.busy), []
        if busy.isEmpty():
            return
        full = busy.join(self._sets(busy.select("cid")), "cid")
        edges = self.work.table(self._at_nodes(full).mapInArrow(_links(self.pct), "u binary, v binary"), f"links{self.confirmed}")
        if edges.isEmpty():
            return
        moved = components(edges).withColumnRenamed("node", "cid")
        if self.label is not None:
            # a component's name is one of its classes, so its own row moves it
            moved = self.work.table(moved, f"moved{self.confirmed}")
            to = moved.select(F.col("cid").alias("root"), F.col("root").alias("new"))
            old = self.label.join(to, "root", "left").select("cid", F.coalesce("new", "root").alias("root"))
            moved = old.unionByName(moved).distinct()
        self.label = self.work.table(moved, f"label{self.confirmed}")
        self.known = self.classes.join(self.label, "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")


def near_duplicates(docs: DataFrame, threshold_pct: int = 80, k: int = 5, recall: float = 0.999999, node_limit: int = 512, levels: int = PERMUTATIONS) -> DataFrame:
    """Near-duplicate components of (doc_id, text).

    Returns one row per input row: doc_id, n_shingles, component_id (the
    smallest doc_id that links reach, itself included), kept (doc_id =
    component_id).

    Links hold where 100 * intersection >= threshold_pct * union of the full
    shingle sets; equal sets are one class and need no links. Null or empty
    texts, and texts without words, have no shingles, link with nothing and are
    kept. A row whose doc_id is null takes part in linking; its component_id is
    the smallest id that is not null, and it is kept only if there is none.
    Rows that repeat a doc_id are linked each by its own text. Other columns
    are ignored. An empty table gives an empty result.

    Nodes branch until they are small or connected. Each level divides a group
    of texts that are less alike than the threshold; ``recall`` is promised for
    a pair whose nodes are small after DEPTH branchings. A path ends where it
    has used all minwise tokens; ``levels`` is beyond that.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near-dedup")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = work.keep(source.mapInArrow(_sketches(k), _SKETCH))
    # a class is made of equal sets, so any of its sketches is all of theirs
    classes = work.table(base.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig")), "classes")
    threshold = threshold_pct / 100
    trees = trees_for(threshold, recall)
    join = _Join(source, classes, work, k, threshold_pct, node_limit)
    large = join.compare(_roots(join.known, range(min(PILOT, trees)), threshold), True)
    join.confirm()
    level = None
    if trees > PILOT:
        join.known = work.table(join.known, "known")
        level = _roots(join.known, range(PILOT, trees), threshold)
    for depth in range(levels):
        if large is not None and (children := join.settled(large, level is None)) is not None:
            level = children if level is None else level.unionByName(children)
        if level is None:
            break
        large, level = join.compare(level, depth == 0), None
        if depth == 0:
            join.confirm()
    if join.busy:
        join.confirm()
    if join.label is None:
        by_class = classes.select("cid", F.col("rep").alias("component_id"))
    else:
        linked = join.label.join(classes.select("cid", "rep"), "cid")
        named = linked.groupBy("root").agg(F.min("rep").alias("component_id")).join(join.label, "root").select("cid", "component_id")
        by_class = classes.select("cid", "rep").join(named, "cid", "left").select("cid", F.coalesce("component_id", "rep").alias("component_id"))
    by_class = work.table(by_class, "by_class")
    shingled = base.filter("cid is not null").select("doc_id", "n_shingles", "cid").join(by_class, "cid").select("doc_id", "n_shingles", "component_id")
    out = shingled.unionByName(base.filter("cid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    result = work.table(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "result")
    work.free()
    return result


def drop_near_duplicates(docs: DataFrame, threshold_pct: int = 80, **parameters) -> DataFrame:
    """The rows of docs that stay when one document of each group stays, with all their columns.

    A doc_id goes if near_duplicates keeps none of its rows. Rows without a
    doc_id stay, as no decision can name them.
    """
    found = near_duplicates(docs, threshold_pct, **parameters)
    gone = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
