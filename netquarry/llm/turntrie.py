"""A prefix trie of conversations by an external mergesort whose runs carry LCPs.

A conversation is the sequence of its turns; each turn is 16 bytes of SHA-256 over role and
text plus the text's length, so a conversation is a short byte string however long
its texts are. Tasks sort bounded runs and note for each row how many turns it shares with
the row before it in its run (LCP). Runs are dealt into ranges of (turns,
conversation) by row, so copies of one conversation spread over ranges too. In a range a
tree of losers merges the runs: of two heads the one that shares more turns with
the last row written is smaller, and turns are compared only beyond equal LCPs.
The merged stream runs over a stack of open nodes; a node is finished when a
row leaves it. Nodes that the first or last row of a range passes through may go on in the
neighbouring ranges: a range keeps partial sums of these two spines, and one
pass over the spines (two rows a range) finishes them by the same stack.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, folder

TURN = 16
#: Rows of one run, bytes of one range, conversation ids in one part of a digest.
RUN, RANGE, ENDS = 1 << 16, 1 << 24, 1 << 12


def turn_hex(role: str, text: str) -> Column:
    """The 16 bytes that stand for a turn, as hex."""
    return F.substring(F.sha2(F.concat(F.sha2(F.col(role).cast("binary"), 256), F.col(text)).cast("binary"), 256), 1, 2 * TURN)


def shared_turns(a: bytes, b: bytes, at: int) -> int:
    """How many turns a and b share, given that they share `at`."""
    most = min(len(a), len(b)) // TURN
    while at < most and a[at * TURN : (at + 1) * TURN] == b[at * TURN : (at + 1) * TURN]:
        at += 1
    return at


def merged(runs: list[list[tuple]]) -> Iterator[tuple[tuple, int]]:
    """(row, turns shared with the row before it) of all runs in order; a row is (turns, conversation, lengths, LCP within its run).

    A tree of losers: each inner node holds the run that lost there and how many
    turns its head shares with the row that beat it.
    """
    n = max(1, len(runs))
    heads: list[tuple | None] = [r[0] if r else None for r in runs] or [None]
    at = [0] * n
    lcp = [0] * n
    loser = [-1] * n

    def lost(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs whose heads have LCPs with the same row; the loser's becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        shared = shared_turns(x[0], y[0], lcp[a])
        k = shared * TURN
        one, two = (x[0][k : k + TURN], x[1]), (y[0][k : k + TURN], y[1])
        first, second = (a, b) if one <= two else (b, a)
        lcp[second] = shared
        return first, second

    won = [-1] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        won[node], loser[node] = lost(won[2 * node], won[2 * node + 1])
    winner = won[1] if n > 1 else 0
    while (row := heads[winner]) is not None:
        yield row, lcp[winner]
        at[winner] += 1
        run = runs[winner]
        heads[winner] = run[at[winner]] if at[winner] < len(run) else None
        lcp[winner] = run[at[winner]][3] if at[winner] < len(run) else 0
        node = (winner + n) // 2
        while node:
            winner, loser[node] = lost(winner, loser[node])
            node //= 2


class _Node:
    """An open node: its members so far, and sums over its finished children."""

    __slots__ = ("children", "ends", "kids", "least", "leaves", "left", "length", "n", "saved")

    def __init__(self, length: int, left: bool = False) -> None:
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.length, self.left = length, left
        self.kids: list[int] = []  # finished children wait for this node's smallest member
        self.ends = array("q")

    def join(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def close(self, parent: _Node | None) -> None:
        """No row enters any more: the node counts itself, and its parent counts it."""
        if not self.children:
            self.leaves = 1
        self.saved += (self.n - 1) * self.length
        if parent is not None:
            parent.children += 1
            parent.leaves += self.leaves
            parent.saved += self.saved

    def sums(self) -> list[int | None]:
        return [self.n, self.least, self.children, self.leaves, self.saved]


def ends_sha256(ids: array) -> str:
    digest = hashlib.sha256()
    for k in range(0, len(ids), ENDS):
        digest.update(((k > 0) * "," + ",".join(map(str, ids[k : k + ENDS]))).encode())
    return digest.hexdigest()


_NODE = pa.schema([("part", pa.int32()), ("side", pa.int32()), ("parent_depth", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
_RANGE = pa.schema([*_NODE, ("kind", pa.string()), ("path", pa.binary()), ("lengths", pa.list_(pa.int32())), ("sums", pa.list_(pa.list_(pa.int64()))), ("seq", pa.int32()), ("ends", pa.string())])
_RANGE_DDL = "part int, side int, parent_depth long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, kind string, path binary, lengths array<int>, sums array<array<long>>, seq int, ends string"
_NUMBERS = [f.name for f in _NODE if f.name not in ("part", "ends_sha256")]


def swept(part: int, rows: Iterator[tuple[tuple, int]]) -> Iterator[pa.RecordBatch]:
    """One range's finished nodes, its two spines, and the ids that end at nodes of the spines, in parts.

    side (0: the first row's spine, 1: the last row's) and parent_depth name a parent that
    is not finished in this range. Nodes that both spines share belong to side 1.
    """
    finished: dict[str, array] = {name: array("q") for name in _NUMBERS}
    digests: list[str] = []
    left: dict[int, _Node] = {}
    stack = [_Node(0)]
    first = row = None

    def pop(depth: int) -> None:
        while len(stack) - 1 > depth:
            node, d = stack.pop(), len(stack)
            stack[-1].join(node.n, node.least)
            if node.left:
                left[d] = node
                continue
            node.close(stack[-1])
            for k in node.kids:
                finished["parent_conv_id"][k] = node.least
            stack[-1].kids.append(len(digests))
            for name, value in zip(_NUMBERS, (-1, -1, node.least, d, 0, node.n, node.children, node.leaves, node.saved)):
                finished[name].append(value)
            digests.append(ends_sha256(node.ends))

    for row, shared in rows:
        path, conv, lengths = row[:3]
        pop(shared if first else 0)
        first = first or row
        for d in range(len(stack) - 1, len(path) // TURN):
            stack.append(_Node(lengths[d], first is row))
        stack[-1].join(1, conv)
        stack[-1].ends.append(conv)
    if first is None:
        return
    for d in range(len(stack) - 1, 0, -1):  # the last row's path stays open, but its counts go up
        stack[d - 1].join(stack[d].n, stack[d].least)
    spines = []
    for side, path, nodes in ((0, first, left), (1, row, dict(enumerate(stack)))):
        for d, node in nodes.items():
            for k in node.kids:
                finished["side"][k], finished["parent_depth"][k] = side, d
        sums = [nodes[d].sums() if d in nodes else None for d in range(len(path[0]) // TURN + 1)]
        spines.append({"part": part, "side": side, "kind": "spine", "path": path[0], "lengths": path[2], "sums": sums})
        for d, node in nodes.items():
            for k in range(0, len(node.ends), ENDS):
                spines.append({"part": part, "side": side, "depth": d, "kind": "ends", "seq": k // ENDS, "ends": ",".join(map(str, node.ends[k : k + ENDS]))})
    for k in range(0, len(digests), RUN):
        cells = {name: pa.array(np.frombuffer(finished[name], np.int64)[k : k + RUN]).cast(_NODE.field(name).type) for name in _NUMBERS}
        known = pa.array(np.frombuffer(finished["side"], np.int64)[k : k + RUN] >= 0)
        cells["parent_conv_id"] = pc.if_else(known, pa.scalar(None, pa.int64()), cells["parent_conv_id"])
        n = len(known)
        cells |= {"part": pa.array([part] * n, pa.int32()), "ends_sha256": pa.array(digests[k : k + RUN]), "kind": pa.array(["node"] * n)}
        yield pa.RecordBatch.from_arrays([cells.get(f.name, pa.nulls(n, f.type)) for f in _RANGE], schema=_RANGE)
    for spine in spines:
        yield pa.RecordBatch.from_pylist([spine], schema=_RANGE)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of at most RUN rows; lcp: turns shared with the row before in the run."""
    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            rows = batch.slice(at, RUN)
            paths, convs = rows["path"].to_pylist(), rows["conv_id"].to_pylist()
            order = sorted(range(len(paths)), key=lambda i: (paths[i], convs[i]))
            lcp = [0] + [shared_turns(paths[a], paths[b], 0) for a, b in zip(order, order[1:])]
            sorted_rows = rows.take(pa.array(order))
            yield pa.RecordBatch.from_arrays([sorted_rows["path"], sorted_rows["conv_id"], sorted_rows["lengths"], pa.array([(part << 32) + count] * len(lcp), pa.int64()), pa.array(range(len(lcp)), pa.int32()), pa.array(lcp, pa.int32())], ["path", "conv_id", "lengths", "run", "place", "lcp"])
            count += 1


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs' rows of one range and sweeps over them."""
    runs: dict[int, list[tuple]] = {}
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("run", "place", "path", "conv_id", "lengths", "lcp"))
        for run, place, path, conv, lengths, lcp in zip(*columns):
            runs.setdefault(run, []).append((place, path, conv, array("i", lengths), lcp))
    lists = []
    for rows in runs.values():
        rows.sort(key=lambda r: r[0])
        follows = [0] + [b[0] == a[0] + 1 for a, b in zip(rows, rows[1:])]
        lists.append([(path, conv, lengths, lcp if f else 0) for f, (_, path, conv, lengths, lcp) in zip(follows, rows)])
    runs.clear()
    yield from swept(TaskContext.get().partitionId(), merged(lists))


def _joined_spines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that lie on spines, finished over all ranges in order: a row for each range's share of a node, with the node's number; the node's own values stand in its first row."""
    stack: list[_Node] = []
    shares: list[list[tuple[int, int, int]]] = []
    nodes: list[tuple] = []
    before = b""

    def pop(depth: int) -> None:
        while len(stack) > depth + 1:
            node = stack.pop()
            node.close(stack[-1] if stack else None)
            if stack:
                stack[-1].kids.append(len(nodes))
            for k in node.kids:
                nodes[k][-1]["parent_conv_id"] = node.least
            nodes.append((shares.pop(), {"conv_id": node.least, "depth": len(stack), "parent_conv_id": None, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}))

    for batch in batches:
        for row in batch.to_pylist():
            path = row["path"]
            pop(shared_turns(before, path, 0))
            for d in range(len(stack), len(path) // TURN + 1):
                stack.append(_Node(row["lengths"][d - 1] if d else 0))
                shares.append([])
            for d, sums in enumerate(row["sums"]):
                if sums is not None:
                    stack[d].join(sums[0], sums[1])
                    stack[d].children += sums[2]
                    stack[d].leaves += sums[3]
                    stack[d].saved += sums[4]
                    shares[d].append((row["part"], row["side"], d))
            before = path
    pop(-1)
    rows = [{"number": k, "part": part, "side": side, "at": d, "top": j == 0, **values} for k, (places, values) in enumerate(nodes) for j, (part, side, d) in enumerate(places)]
    for k in range(0, len(rows), RUN):
        yield pa.RecordBatch.from_pylist(rows[k : k + RUN], schema=_SHARE)


_SHARE = pa.schema([("number", pa.int64()), ("part", pa.int32()), ("side", pa.int32()), ("at", pa.int64()), ("top", pa.bool_()), *((f, pa.int64()) for f in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))])
_SHARE_DDL = "number long, part int, side int, at long, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each number's parts of ids, which come one after another."""
    number, digest = None, hashlib.sha256()
    out = lambda: pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "ends_sha256": pa.array([digest.hexdigest()])})
    for batch in batches:
        for n, ids in zip(batch["number"].to_pylist(), batch["ends"].to_pylist()):
            if n != number:
                if number is not None:
                    yield out()
                number, digest = n, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if number is not None:
        yield out()


def conversations(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, (turn, hex, length) each; hex stands for role and text, length counts code points.

    Turns are ordered by number, null first, equal numbers by hex; null role or text is empty; rows without a conversation are left out.
    """
    clean = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    turns = clean.select("conv_id", F.struct("turn", turn_hex("role", "text").alias("hex"), F.length("text").alias("length")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, turns) with the first h = crc32(decimal conv_id) % 6 turns taken from conversation conv_id - conv_id % 100, where there is one."""
    bases = convs.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("opening"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    found = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(bases, "base", "left").withColumn("h", h)
    opening = F.coalesce(F.expr("slice(opening, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return found.select("conv_id", F.concat(opening, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the prefix trie over (conv_id, turns), conv_id not null and each once, turns as conversations() gives them.

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's; null at the root), n_convs (members), n_children,
    n_leaves (childless nodes in the subtree, itself included), saved_tokens (over the subtree, (members - 1) * length of the
    last turn) and ends_sha256 (of the ids that end at the node, ascending, joined by commas). A conversation without turns ends
    at the root; no conversations give no nodes. Copies of conversations count each; other columns are not read.

    A task holds one range (RANGE bytes of turns, or one conversation: 20 bytes a turn); one task
    passes over two rows a range, and the decimal ids that end at one node of a spine stream through the task that hashes them.
    """
    spark = convs.sparkSession
    paths = convs.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["hex"]), "")).alias("path"), "conv_id", F.transform("turns", lambda t: t["length"]).alias("lengths"))
    runs = cut(paths.mapInArrow(_runs, "path binary, conv_id long, lengths array<int>, run long, place int, lcp int"))
    size = runs.agg(F.sum(F.length("path") + 16)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    path = f"{folder(spark)}/trie-{uuid.uuid4().hex}"
    runs.repartitionByRange(parts, "path", "conv_id").mapInArrow(_range, _RANGE_DDL).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(_RANGE_DDL).parquet(path)
    spines = found.where("kind = 'spine'").select("part", "side", "path", "lengths", "sums")
    shares = cut(spines.repartition(1).sortWithinPartitions("part", "side").mapInArrow(_joined_spines, _SHARE_DDL))
    values = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = found.where("kind = 'ends'").select("part", "side", F.col("depth").alias("at"), "seq", "ends").join(shares.select("number", "part", "side", "at"), ["part", "side", "at"])
    digests = ends.repartition(F.col("number")).sortWithinPartitions("number", "part", "side", "seq").select("number", "ends").mapInArrow(_hashed, "number long, ends_sha256 string")
    empty = hashlib.sha256().hexdigest()
    borders = shares.where("top").join(digests, "number", "left").select(*values, F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    nodes = found.where("kind = 'node'")
    whole = nodes.where("side < 0").select(*values, "ends_sha256")
    parents = shares.select("part", "side", F.col("at").alias("parent_depth"), F.col("conv_id").alias("up"))
    below = nodes.where("side >= 0").drop("parent_conv_id").join(parents, ["part", "side", "parent_depth"]).withColumnRenamed("up", "parent_conv_id").select(*values, "ends_sha256")
    return whole.unionByName(below).unionByName(borders)
