"""Prefix trie of conversations by a merge sort that knows common prefixes.

A turn travels as a token of 20 bytes (128 bits of the SHA-256 of role and text, then the text's length in bytes), a conversation as
its tokens in a row, so texts are never shuffled. Equal conversations are one sequence with a number of members. Sequences are
dealt into ranges; a task sorts each batch into a run that carries, with each sequence, how many turns it shares with the one
before (its LCP), and merges the runs by a loser tree that compares LCPs first and turns only where they are equal, from the
first turn that is not known to be shared. The merged stream drives a stack of open nodes: what a sequence does not share
with the one before is closed and finished.

Only nodes on a range's first and last path can go on in other ranges. Their parts are added up by key, and the few that do go on
are closed, deepest first, in one task: at most (ranges - 1) times the turns that neighbours share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import column, partitions, shared_folder, written

#: Bytes of a token; bytes of the sequences of a range; lower bits of a conversation id that its block leaves open.
TOKEN, RANGE_BYTES, BLOCK_BITS = 20, 4 << 20, 16
#: Nodes that are given out at once.
EMIT = 1 << 14
#: SHA-256 of the empty string.
NONE = hashlib.sha256(b"").hexdigest()


def token(role: Column, text: Column) -> Column:
    """20 bytes that stand for a turn; null role or text is an empty one."""
    r, t = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    named = F.concat(F.length(r).cast("string"), F.lit(":"), r, t)
    return F.unhex(F.concat(F.substring(F.sha2(named.cast("binary"), 256), 1, 32), F.lpad(F.hex(F.octet_length(t).cast("long")), 8, "0")))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): the tokens of each conversation by turn, null first, ties by role, then by token.

    A null role or text is an empty one. Turns without a conversation id belong to no conversation.
    """
    row = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.coalesce("role", F.lit("")).alias("c"), token(F.col("role"), F.col("text")).alias("d"))
    made = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return made.select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex(F.array_join(F.transform("rows", lambda x: F.hex(x["d"])), "")).alias("seq"))


def spliced(seqs: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """Conversations that begin with turns of another: the first h turns of c - c % every, then c's own after its first h.

    h is the CRC-32 of the id in decimal, modulo most + 1; an absent conversation has no turns.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int")
    heads = seqs.where(c % every == 0).select(c.alias("base"), F.substring("seq", 1, most * TOKEN).alias("head"))
    own = seqs.join(heads, c - c % every == F.col("base"), "left")
    head = F.coalesce("head", F.lit(b""))
    return own.select("conv_id", F.concat(head.substr(F.lit(1), h * TOKEN), F.col("seq").substr(h * TOKEN + 1, F.octet_length("seq"))).alias("seq"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of members, by sequence and rising: one row a sequence; a digest grows block by block, so no list of ids is held whole."""
    key, state, out = None, None, []

    def rows() -> pa.RecordBatch:
        seq, n, least, ends = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(seq, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64()), pa.array(ends)], ["seq", "n", "least", "ends"])

    for batch in batches:
        for k, seq, n, least, ids in zip(*(column(batch, c).to_pylist() for c in ("key", "seq", "n", "least", "ids")), strict=True):
            if k != key:
                if state:
                    out.append((state[0], state[1], state[2], state[3].hexdigest()))
                key, state = k, [seq, n, least, hashlib.sha256(ids.encode())]
            else:
                state[1] += n
                state[3].update(b"," + ids.encode())
        if len(out) >= EMIT:
            yield rows()
            out = []
    if state:
        out.append((state[0], state[1], state[2], state[3].hexdigest()))
    if out:
        yield rows()


def collapsed(seqs: DataFrame) -> DataFrame:
    """(seq, n, least, ends) of each different sequence: members, the smallest, SHA-256 of their ids, rising and comma-joined.

    Ids meet in blocks of neighbouring numbers, which bound a list; a sequence's blocks follow each other through one task.
    """
    block = seqs.groupBy(F.unhex(F.sha2("seq", 256)).alias("key"), F.shiftright("conv_id", BLOCK_BITS).alias("block"))
    ids = block.agg(F.array_sort(F.collect_list("conv_id")).alias("i"), F.first("seq").alias("seq"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    ids = ids.select("key", "block", "seq", "n", "least", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("ids"))
    return ids.repartition(partitions(seqs.sparkSession), "key").sortWithinPartitions("key", "block").mapInArrow(_members, "seq binary, n long, least long, ends string")


# --- runs and their merge ------------------------------------------------------------------------------------


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences begin with alike; ``known`` ones are not compared again."""
    most = min(len(a), len(b)) // TOKEN
    while known < most and a[known * TOKEN : (known + 1) * TOKEN] == b[known * TOKEN : (known + 1) * TOKEN]:
        known += 1
    return known


class Run:
    """Sorted rows (sequence first), each with the turns that it shares with the row before."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = sorted(rows)
        self.lcp = [0] + [shared(a[0], b[0]) for a, b in zip(self.rows[:-1], self.rows[1:], strict=True)]
        self.at = 0


class LoserTree:
    """Merges runs; gives rows with the turns that each shares with the row given before it.

    Every loser on the way of the last winner to the root lost to it, so their LCPs and that of the winner's successor refer to one
    sequence: the larger LCP wins without a look at the turns; of equal ones the turns after it decide and give the loser's new LCP.
    """

    def __init__(self, runs: list[Run]) -> None:
        self.runs, self.compared = runs, 0
        self.size = max(1, 1 << (len(runs) - 1).bit_length()) if runs else 1
        self.lcp = [0] * self.size
        self.loser = [0] * self.size
        self.winner = self._play(1)

    def _head(self, i: int) -> bytes | None:
        r = self.runs[i] if i < len(self.runs) else None
        return r.rows[r.at][0] if r is not None and r.at < len(r.rows) else None

    def _match(self, i: int, j: int) -> tuple[int, int]:
        """Winner and loser."""
        a, b = self._head(i), self._head(j)
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if self.lcp[i] != self.lcp[j]:
            return (i, j) if self.lcp[i] > self.lcp[j] else (j, i)
        k = shared(a, b, self.lcp[i])
        self.compared += k - self.lcp[i] + 1
        win, lose = (i, j) if (a[k * TOKEN :], i) <= (b[k * TOKEN :], j) else (j, i)
        self.lcp[lose] = k
        return win, lose

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, self.loser[node] = self._match(self._play(2 * node), self._play(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while self._head(self.winner) is not None:
            i = self.winner
            run = self.runs[i]
            yield self.lcp[i], run.rows[run.at]
            run.at += 1
            self.lcp[i] = run.lcp[run.at] if run.at < len(run.rows) else 0
            node, win = (i + self.size) >> 1, i
            while node:
                win, self.loser[node] = self._match(win, self.loser[node])
                node >>= 1
            self.winner = win


# --- nodes ---------------------------------------------------------------------------------------------------

_NODE = "key binary, parent binary, depth long, token binary, n long, least long, children long, leaves long, saved long, ends string, parent_least long, path boolean, own_children long, own_leaves long, own_saved long"
_FIELDS = [c.split(" ")[0] for c in _NODE.split(", ")]
_KINDS = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_TYPES = [_KINDS[c.split(" ")[1]] for c in _NODE.split(", ")]
_ROOT = b"\0" * 16


class _Open:
    __slots__ = ("key", "parent", "depth", "token", "first", "n", "least", "children", "leaves", "saved", "ends", "own_children", "own_leaves", "own_saved")

    def __init__(self, key: bytes, parent: _Open | None, depth: int, token: bytes, first: bool) -> None:
        self.key, self.parent, self.depth, self.token, self.first = key, parent, depth, token, first
        self.n, self.least, self.ends = 0, None, None
        self.children = self.leaves = self.saved = self.own_children = self.own_leaves = self.own_saved = 0

    def close(self, path: bool) -> None:
        """Adds this node to its parent. What is on no edge path is the parent's own; the rest is counted once all ranges are added up."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * int.from_bytes(self.token[16:], "big")
        up = self.parent
        if up is not None:
            up.n += self.n
            up.least = self.least if up.least is None else min(up.least, self.least)
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + self.leaves, up.saved + self.saved
            if not path:
                up.own_children, up.own_leaves, up.own_saved = up.own_children + 1, up.own_leaves + self.leaves, up.own_saved + self.saved

    def row(self, path: bool, parent_known: bool) -> tuple:
        up = self.parent
        return (self.key, up.key if up else None, self.depth, self.token, self.n, self.least, self.children, self.leaves, self.saved, self.ends, up.least if up and parent_known else None, path, self.own_children, self.own_leaves, self.own_saved)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a range; ``path`` marks those on its first or last path, whose parts other ranges may have too."""
    runs = [Run(list(zip(*(column(b, c).to_pylist() for c in ("seq", "n", "least", "ends")), strict=True))) for b in batches if b.num_rows]
    if not runs:
        return

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _FIELDS)

    stack = [_Open(_ROOT, None, 0, b"\0" * TOKEN, True)]
    on_first, ready, waiting, begun = 0, [], [], False
    for lcp, (seq, n, least, ends) in LoserTree(runs):
        while len(stack) - 1 > lcp:
            node = stack.pop()
            node.close(node.first)
            if node.first:
                ready.append(node.row(True, False))
            else:
                waiting.append(node)
        on_first = min(on_first, lcp) if begun else len(seq) // TOKEN
        if len(stack) - 1 <= on_first and waiting:  # all that waits hangs from a path node, whose numbers come later, or below
            ready += [x.row(False, not x.parent.first) for x in waiting]
            waiting = []
        for d in range(len(stack), len(seq) // TOKEN + 1):
            t = seq[(d - 1) * TOKEN : d * TOKEN]
            stack.append(_Open(hashlib.blake2b(stack[-1].key + t, digest_size=16).digest(), stack[-1], d, t, not begun))
        top = stack[-1]
        top.n, top.ends = top.n + n, ends
        top.least = least if top.least is None else min(top.least, least)
        begun = True
        while len(ready) >= EMIT:
            yield batch(ready[:EMIT])
            ready = ready[EMIT:]
    last = {id(x) for x in stack}
    while stack:
        node = stack.pop()
        node.close(True)
        ready.append(node.row(True, False))
    ready += [x.row(False, not x.parent.first and id(x.parent) not in last) for x in waiting]
    for i in range(0, len(ready), EMIT):
        yield batch(ready[i : i + EMIT])


def _close_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that several ranges have parts of, deepest first: totals over the subtree."""
    below: dict[bytes, list[int]] = {}
    for batch in batches:
        out = []
        for key, parent, n, size, children, leaves, saved in zip(*(column(batch, c).to_pylist() for c in ("key", "parent", "n", "size", "children", "leaves", "saved")), strict=True):
            c, le, s = below.pop(key, [0, 0, 0])
            children, leaves, saved = children + c, leaves + le, saved + s + (n - 1) * size
            leaves = leaves if children else 1
            out.append((key, children, leaves, saved))
            up = below.setdefault(parent, [0, 0, 0])
            up[0], up[1], up[2] = up[0] + 1, up[1] + leaves, up[2] + saved
        if out:
            key, *rest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *(pa.array(x, pa.int64()) for x in rest)], ["key", "c", "l", "s"])


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """A row a node: ``key``, ``parent`` (key), ``token`` (of its last turn), ``depth``, ``conv_id`` (smallest member), ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``seqs`` has ``conv_id`` and ``seq`` (see ``sequences``), a row a conversation. The root is the empty prefix; a conversation without
    turns is a member of it. Without conversations there is no node.
    """
    spark = seqs.sparkSession
    where = shared_folder(spark)
    unlike = written(collapsed(seqs), f"{where}/sequences")
    number = max(partitions(spark), int((unlike.agg(F.sum(F.octet_length("seq"))).first()[0] or 0) // RANGE_BYTES) + 1)
    nodes = written(unlike.repartitionByRange(number, "seq").mapInArrow(_nodes, _NODE), f"{where}/nodes")
    size = F.conv(F.hex(F.substring("token", 17, 4)), 16, 10).cast("long")

    total = lambda c: F.sum(c).alias(c)
    parts = nodes.where("path").groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("token").alias("token"), *map(total, ("n", "children", "leaves", "saved", "own_children", "own_leaves", "own_saved")), F.min("least").alias("least"), F.max("ends").alias("ends"), F.count("*").alias("ranges"))
    parts = written(parts, f"{where}/parts")
    alone, several = parts.where("ranges = 1"), parts.where("ranges > 1")
    hung = alone.groupBy(F.col("parent").alias("up")).agg(F.count("*").alias("hc"), F.sum("leaves").alias("hl"), F.sum("saved").alias("hs"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    own = several.join(hung, several["key"] == hung["up"], "left").select("key", "parent", "depth", "n", size.alias("size"), (F.col("own_children") + zero("hc")).alias("children"), (F.col("own_leaves") + zero("hl")).alias("leaves"), (F.col("own_saved") + zero("hs")).alias("saved"))
    closed = own.repartition(1).sortWithinPartitions(F.col("depth").desc()).mapInArrow(_close_shared, "key binary, c long, l long, s long")
    columns = ["key", "parent", "depth", "token", "n", "least", "ends"]
    done = several.select(*columns).join(closed, "key").select(*columns, F.col("c").alias("children"), F.col("l").alias("leaves"), F.col("s").alias("saved"))
    paths = written(alone.select(*columns, "children", "leaves", "saved").unionByName(done), f"{where}/paths")

    inner = nodes.where("NOT path").select(*paths.columns, "parent_least")
    open_ = inner.where("parent_least IS NULL").drop("parent_least").unionByName(paths)
    ups = paths.select(F.col("key").alias("up"), F.col("least").alias("parent_least"))
    every = open_.join(ups, open_["parent"] == ups["up"], "left").drop("up").unionByName(inner.where("parent_least IS NOT NULL"))
    return every.select("key", "parent", "token", "depth", F.col("least").alias("conv_id"), F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, splice: bool = False) -> DataFrame:
    """``prefix_trie`` of the conversations (conv_id, turn, role, text); ``splice`` lets them begin with turns of another (see ``spliced``)."""
    spark = turns.sparkSession
    seqs = written(sequences(turns), f"{shared_folder(spark)}/conversations")
    return prefix_trie(spliced(seqs) if splice else seqs)


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn; the root has nulls."""
    first = turns.select(token(F.col("role"), F.col("text")).alias("token"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["token"])
    return nodes.join(first, "token", "left")


def trie_nodes(turns: DataFrame) -> DataFrame:
    """Nodes of the spliced conversations."""
    return conversation_trie(turns, splice=True).drop("key", "parent", "token")
