"""The prefix trie of conversations: which openings they share, and what sharing them saves.

A turn becomes a digest of role and text, a conversation the row of its digests. Rows are dealt by range of their digests,
so that what shares an opening lies together; a task cuts its range into shards of bounded size and sorts each as a
matrix padded to its width with numpy's lexsort, ``BAND`` columns at a time (only rows that are longer go on to the next band).
Where a column differs from the row above, a mask is set; accumulated by OR along the row it marks
where nodes start at each depth, and ``reduceat`` over these starts gives every node its members, smallest member and children; subtree sums follow
from the deepest nodes up. Only nodes on the way to the first or last row of a shard can go on in another one: these
chains, two a shard, meet in one task, which is the same walk over two rows a shard, and what hangs below them is
joined to the result by shard, chain and depth.

Conversations are numbers and 20 bytes a turn here; texts are read once and not shuffled. A conversation's digests have to fit in a task, the
longest once as a sort key; many equal conversations do not, they are spread over shards by their ids. The ids that end in a node
that spans shards are hashed in order from pieces of a few kilobytes.

Defined results: turns are ordered by turn (null first), equal ones by digest, and all count, repeated rows included; null roles and texts are empty;
rows without a conversation id form one conversation, which sorts before all others and is named ``null``, as in the text that is hashed;
other columns are left behind; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.frames import NO_ID, arrays_of, id_in, id_out, release_memory, table
from curate.llm.words import buffers

#: Turns of a shard, columns sorted together, and ids in a piece of a long list.
SHARD_TURNS, BAND, PIECE = 1 << 19, 8, 512
#: Bytes of digests and lengths dealt to one task.
TASK_BYTES = 32 << 20
#: Bytes of a turn's digest.
WIDTH = 16

_EMPTY = hashlib.sha256().hexdigest()


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, chars``: the digests of a conversation's turns in order, and the code points of their texts (4 bytes each)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.select(id_in("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).alias("chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, chars = None, [], []
        for batch in batches:
            ids, (digests, _), lengths = batch["conv_id"].to_numpy(), buffers(batch["digest"]), batch["chars"].to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
            done = []
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if ids[a] != now:
                    if path:
                        done.append((now, b"".join(path), b"".join(chars)))
                    now, path, chars = int(ids[a]), [], []
                path.append(digests[WIDTH * a : WIDTH * b].tobytes())
                chars.append(lengths[a:b].astype("<u4").tobytes())
            if done:
                yield _rows(done)
        if path:
            yield _rows([(now, b"".join(path), b"".join(chars))])

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest")
    return table(dealt.mapInArrow(run, "conv_id long, path binary, chars binary"))


def _rows(done: list[tuple]) -> pa.RecordBatch:
    ids, path, chars = zip(*done)
    return arrays_of(conv_id=pa.array(ids, pa.int64()), path=pa.array(path, pa.binary()), chars=pa.array(chars, pa.binary()))


class Walk:
    """Nodes of the trie of some rows of digests, depth by depth.

    ``order`` sorts the rows by digests, shorter ones first, then by ``tie``. Iteration gives for each depth from 1 on: the
    places in that order of the rows that are this deep, where nodes start among them, each such row's node (numbered on
    over all depths, 0 is the root), the nodes' parents, and the digests' numbers.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, length: np.ndarray, tie: np.ndarray):
        self.turn, self.length, self.n = (high, low), length, len(length)
        self.begin = np.cumsum(length) - length
        self.order, self.count = np.arange(self.n), 1
        self.bands = []
        deep, group = np.arange(self.n), np.zeros(self.n, np.int64)
        if not length.any():
            self.order = np.argsort(tie, kind="stable")
        first = 0
        while len(deep) and length[self.order[deep]].max(initial=0) > first:
            rows = self.order[deep]
            width = int(min(BAND, length[rows].max() - first))
            have = length[rows][:, None] > first + np.arange(width)
            at = np.where(have, self.begin[rows][:, None] + first + np.arange(width), 0)
            columns = [np.where(have, t[at], 0) for t in self.turn]
            keys = [tie[rows], length[rows] > first + width]
            for j in range(width - 1, -1, -1):
                keys += [columns[1][:, j], columns[0][:, j], have[:, j]]
            new = np.lexsort([*keys, group])
            self.order[deep], columns, have = rows[new], [c[new] for c in columns], have[new]
            change = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (have[1:] != have[:-1])
            change[:, 0] |= group[1:] != group[:-1]
            start = np.logical_or.accumulate(np.vstack([np.ones((1, width), bool), change]), axis=1)
            self.bands.append((first, deep, have, start))
            more = length[self.order[deep]] > first + width
            deep, group = deep[more], np.cumsum(start[:, -1])[more]
            first += BAND

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        node = np.zeros(self.n, np.int64)
        for first, deep, have, start in self.bands:
            for j in range(have.shape[1]):
                here = have[:, j]
                rows, begins = deep[here], np.flatnonzero(start[here, j])
                parents = node[rows[begins]]
                node[rows] = self.count + np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))
                self.count += len(begins)
                yield first + j + 1, rows, begins, node[rows], parents


def _ends_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join("null" if i == NO_ID else str(i) for i in ids.tolist()).encode()).hexdigest()


#: Result of a shard: nodes that are its own, then parts of those it may share.
_NODE = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SHARD = _NODE + ", shard long, chain int, at long, body binary"


def _batch(kind: int, columns: dict, n: int) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in _SHARD.split(", ")]
    full = {"kind": np.full(n, kind, np.int32)} | columns
    return arrays_of(**{
        name: (full[name] if isinstance(full[name], pa.Array) else pa.array(full[name], types[t])) if name in full else pa.nulls(n, types[t])
        for name, t in fields
    })


def shard_nodes(shard: int, conv: np.ndarray, path: bytes, length: np.ndarray, chars: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Kind 0: nodes within the shard, with (shard, chain, at) of a parent on a chain. Kind 1: the two chains. Kind 2: ids that end on a chain."""
    turn = np.frombuffer(path, ">u8").reshape(-1, 2).astype(np.uint64)
    walk = Walk(turn[:, 0], turn[:, 1], length, conv)
    n, begin = len(conv), walk.begin
    depth, parent, members, smallest, size = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.array([n])], [np.array([conv.min()])], [np.zeros(1, np.int64)]
    last_of, on_chain = np.zeros(n, np.int64), [[0], [0]]
    ordered = conv[walk.order]
    for d, rows, begins, node, parents in walk:
        depth.append(np.full(len(begins), d))
        parent.append(parents)
        members.append(np.diff(np.append(begins, len(rows))))
        smallest.append(np.minimum.reduceat(ordered[rows], begins))
        size.append(chars[begin[walk.order[rows[begins]]] + d - 1].astype(np.int64))
        last_of[rows] = node
        for chain, end in enumerate((0, n - 1)):
            if (at := np.searchsorted(rows, end)) < len(rows) and rows[at] == end:
                on_chain[chain].append(int(node[at]))
    depth, parent, members, smallest, size = map(np.concatenate, (depth, parent, members, smallest, size))
    on_chain = [np.array(nodes) for nodes in on_chain]
    count = len(depth)
    shared = np.zeros(count, bool)
    shared[np.concatenate(on_chain)] = True
    inner = ~shared
    children = np.bincount(parent[1:][inner[1:]], minlength=count)
    has_child = np.bincount(parent[1:], minlength=count) > 0
    leaves, saved = (inner & ~has_child).astype(np.int64), np.where(inner, (members - 1) * size, 0)
    edges = np.searchsorted(depth, np.arange(depth[-1] + 2))
    for d in range(int(depth[-1]), 0, -1):  # parents are numbered before their children, and in their order
        a, b = edges[d], edges[d + 1]
        new = np.flatnonzero(np.r_[True, parent[a + 1 : b] != parent[a : b - 1]])
        for sums in (leaves, saved):
            sums[parent[a + new]] += np.add.reduceat(sums[a:b], new)

    # Rows that end in a node lie together, by id.
    ends = np.flatnonzero(np.r_[True, last_of[1:] != last_of[:-1]])
    digest = np.full(count, _EMPTY, object)
    listed = {}
    for a, b in zip(ends.tolist(), [*ends[1:].tolist(), n]):
        if inner[last_of[a]]:
            digest[last_of[a]] = _ends_digest(ordered[a:b])
        else:
            listed[int(last_of[a])] = ordered[a:b]

    chain_of = np.full(count, -1)
    for chain in (1, 0):
        chain_of[on_chain[chain]] = chain
    own = np.flatnonzero(inner)
    below = shared[parent[own]]
    yield _batch(0, {
        "conv_id": smallest[own], "depth": depth[own], "parent_conv_id": smallest[parent[own]], "n_convs": members[own], "n_children": children[own],
        "n_leaves": leaves[own], "saved_tokens": saved[own], "ends_sha256": digest[own], "shard": np.full(len(own), shard),
        "chain": pa.array(chain_of[parent[own]].astype(np.int32), mask=~below), "at": depth[own] - 1,
    }, len(own))
    bodies = []
    for chain, end in enumerate((0, n - 1)):
        row = walk.order[end]
        nodes = on_chain[chain]
        parts = np.stack([members, smallest, children, leaves, saved, size])[:, nodes]
        if chain:  # what both chains share counts once
            parts[np.ix_([0, 2, 3, 4], np.isin(nodes, on_chain[0]))] = 0
        bodies.append(path[WIDTH * begin[row] : WIDTH * (begin[row] + length[row])] + parts.astype("<i8").tobytes())
    yield _batch(1, {"shard": np.full(2, shard), "chain": np.arange(2), "at": np.array([len(c) - 1 for c in on_chain]), "body": bodies}, 2)
    for node, ids in listed.items():
        where = {"shard": shard, "chain": int(chain_of[node]), "at": int(depth[node])}
        pieces = [ids[i : i + PIECE].astype("<i8").tobytes() for i in range(0, len(ids), PIECE)]
        yield _batch(2, {k: np.full(len(pieces), v) for k, v in where.items()} | {"n_convs": np.arange(len(pieces)), "body": pieces}, len(pieces))


def shards(rows: DataFrame, shard_turns: int) -> DataFrame:
    """The written results of all shards of ``conv_id, path, chars``."""
    total = rows.agg(F.sum(F.octet_length("path") + F.octet_length("chars") + 8)).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // TASK_BYTES)), "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, turns = TaskContext.get().partitionId() << 32, [], 0

        def close():
            whole = pa.Table.from_batches(held).combine_chunks()
            conv, path, chars = (whole[c].chunk(0) for c in ("conv_id", "path", "chars"))
            length = np.array(pc.binary_length(path), np.int64) // WIDTH
            raw, counts = b"".join(path.to_pylist()), np.frombuffer(b"".join(chars.to_pylist()), "<u4")
            yield from shard_nodes(shard, conv.to_numpy(), raw, length, counts)

        for batch in batches:
            upto = np.cumsum(np.array(pc.binary_length(batch["path"]), np.int64) // WIDTH + 1)
            first = 0
            while first < batch.num_rows:
                done = upto[first - 1] if first else 0
                last = int(np.searchsorted(upto, done + shard_turns - turns, "right"))
                last = max(last, first if held else first + 1)
                if last > first:
                    held.append(batch.slice(first, last - first))
                    turns += int(upto[last - 1] - done)
                if last < batch.num_rows:
                    yield from close()
                    shard, held, turns = shard + 1, [], 0
                first = last
        if held:
            yield from close()
        release_memory()

    return table(dealt.mapInArrow(run, _SHARD))


#: Nodes on chains, and the place of each in a shard.
_SHARED = "node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, shard long, chain int, at long"


def shared_nodes(chains: DataFrame) -> DataFrame:
    """Nodes on chains from all their parts; further rows (``depth`` null) tell which node stands at which place of a chain."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("shard", "ascending"), ("chain", "ascending")])
        shard, chain, length = (rows[c].to_numpy() for c in ("shard", "chain", "at"))
        bodies = rows["body"].to_pylist()
        turn = np.frombuffer(b"".join(b[: WIDTH * n] for b, n in zip(bodies, length.tolist())), ">u8").reshape(-1, 2).astype(np.uint64)
        parts = [np.frombuffer(b[WIDTH * n :], "<i8").reshape(6, n + 1) for b, n in zip(bodies, length.tolist())]
        part = np.concatenate(parts, axis=1)
        walk = Walk(turn[:, 0], turn[:, 1], length, np.arange(len(length)))
        at = np.cumsum(length + 1) - length - 1
        levels = [(0, np.arange(len(length)), np.zeros(1, np.int64), np.zeros(len(length), np.int64), np.zeros(1, np.int64)), *walk]
        out, places = [], []
        for d, row, begins, node, parents in levels:
            cell = part[:, at[walk.order[row]] + d]
            sums = np.add.reduceat(cell, begins, axis=1)
            out.append(np.vstack([np.full(len(begins), d), parents, sums[0], np.minimum.reduceat(cell[1], begins), sums[2:5], np.maximum.reduceat(cell[5], begins)]))
            places.append(np.vstack([node, shard[walk.order[row]], chain[walk.order[row]], np.full(len(row), d)]))
        edges = np.cumsum([0, *(o.shape[1] for o in out)])
        depth, parent, members, smallest, children, leaves, saved, size = np.concatenate(out, axis=1)
        children = children + np.bincount(parent[1:], minlength=len(depth))
        own_leaf, own_saved = (children == 0).astype(np.int64), (members - 1) * size
        for a, b in zip(edges[-2:0:-1].tolist(), edges[:1:-1].tolist()):
            for sums in (own_leaf, own_saved):
                np.add.at(sums, parent[a:b], sums[a:b])
        names = [f.split()[0] for f in _SHARED.split(", ")]
        found = dict(node=np.arange(len(depth)), conv_id=smallest, depth=depth, parent_conv_id=smallest[parent], n_convs=members, n_children=children,
                     n_leaves=leaves + own_leaf, saved_tokens=saved + own_saved)
        known = pa.table({n: found[n] if n in found else pa.nulls(len(depth), pa.int32() if n == "chain" else pa.int64()) for n in names})
        node, of, which, d = np.concatenate(places, axis=1)
        place = dict(node=node, conv_id=smallest[node], shard=of, chain=which.astype(np.int32), at=d)
        return pa.concat_tables([known, pa.table({n: place[n] if n in place else pa.nulls(len(node), pa.int64()) for n in names})])

    return table(chains.select("shard", "chain", "at", "body").groupBy().applyInArrow(run, _SHARED))


def ends_of_shared(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of nodes on chains, from the pieces of their ids."""
    found = pieces.select("shard", "chain", "at", F.col("n_convs").alias("piece"), "body").join(places.select("shard", "chain", "at", "node"), ["shard", "chain", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in batches:
            for node, body in zip(batch["node"].to_pylist(), batch["body"].to_pylist()):
                if node != now:
                    if digest:
                        done.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join("null" if i == NO_ID else str(i) for i in np.frombuffer(body, "<i8").tolist()).encode())
        if digest:
            done.append((now, digest.hexdigest()))
        if done:
            yield arrays_of(node=pa.array([n for n, _ in done], pa.int64()), ends_sha256=[h for _, h in done])

    dealt = found.select("node", "shard", "piece", "body").repartition("node").sortWithinPartitions("node", "shard", "piece")
    return dealt.mapInArrow(run, "node long, ends_sha256 string")


def build(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of conversations given as ``conv_id, path, chars`` (see ``paths``), one row per node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves``,
    ``saved_tokens`` (per node of the subtree, members but one times code points of its last text), ``ends_sha256`` (digest of
    the ids of the members that end here).
    """
    result = shards(rows, shard_turns)
    shared = shared_nodes(result.filter("kind = 1"))
    places, nodes = shared.filter("depth IS NULL"), shared.filter("depth IS NOT NULL")
    ends = ends_of_shared(result.filter("kind = 2"), places)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    hung = places.select("shard", "chain", "at", F.col("conv_id").alias("_parent"))
    own = result.filter("kind = 0").join(hung, ["shard", "chain", "at"], "left")
    own = own.withColumn("parent_conv_id", F.coalesce("_parent", "parent_conv_id")).select(columns)
    whole = nodes.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    root = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    both = own.unionByName(whole.withColumn("parent_conv_id", root).select(columns))
    return both.withColumns({c: id_out(c) for c in ("conv_id", "parent_conv_id")})
