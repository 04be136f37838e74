"""Many literals at once: an automaton for occurrences anywhere, a trie for prefixes.

Both are built from a *table* of literals, in arrays, level by level. A text is read once, whatever the number of literals; texts are
cut into lanes (with an overlap as long as the longest literal), and all lanes of a batch advance by one byte in one array operation.
Literals are sent to the tasks in groups of bounded size, and each task builds its own arrays; beyond one group the
texts are read once per group. Empty and null literals match nothing, null texts contain nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.session import materialize

#: Bytes of literals in one automaton (its table has a row per byte) and in one trie of prefixes.
GROUP_BYTES, PREFIX_BYTES = 1 << 17, 1 << 21
#: Bytes of a lane, and of the text that is scanned together.
LANE, CHUNK = 512, 4 << 20


def literal_groups(literals: DataFrame, literal: str, limit: int) -> list[list[bytes]]:
    """The distinct literals in groups of about ``limit`` bytes, by hash."""
    distinct = materialize(literals.select(F.col(literal).cast("string").alias("l")).filter("l <> ''").distinct())
    total = distinct.agg(F.sum(F.octet_length("l"))).first()[0] or 0
    n = -(-total // limit)
    of = F.pmod(F.xxhash64("l"), F.lit(max(n, 1)))
    found = [distinct.filter(of == i).toArrow()["l"].cast(pa.binary()).to_pylist() for i in range(n)]
    return [sorted(group) for group in found if group]


def _levels(literals: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Nodes of the trie of sorted, distinct literals by depth: per depth parents and bytes; node and length of each literal.

    Node 0 is the root; nodes are numbered by depth and order.
    """
    length = np.array([len(x) for x in literals], np.int64)
    data, begin = np.frombuffer(b"".join(literals), np.uint8), np.cumsum(length) - length
    node, levels, count = np.zeros(len(literals), np.int64), [], 1
    final = np.zeros(len(literals), np.int64)
    deep = np.arange(len(literals))
    for depth in range(int(length.max(initial=0))):
        deep = deep[length[deep] > depth]
        byte, parent = data[begin[deep] + depth], node[deep]
        new = np.r_[True, (parent[1:] != parent[:-1]) | (byte[1:] != byte[:-1])]
        node[deep] = count - 1 + np.cumsum(new)
        levels.append((parent[new], byte[new]))
        count += int(new.sum())
        done = deep[length[deep] == depth + 1]
        final[done] = node[done]
    return levels, final, length


class Automaton:
    """Complete transitions of a set of literals (failures resolved), and which literals end in a state."""

    def __init__(self, literals: list[bytes]):
        levels, final, self.length = _levels(literals)
        used = np.unique(np.frombuffer(b"".join(literals), np.uint8))
        classes = np.zeros(256, np.int64)
        classes[used] = np.arange(1, len(used) + 1)
        width, count = len(used) + 1, 1 + sum(len(p) for p, _ in levels)
        step, fail = np.zeros((count, width), np.int32), np.zeros(count, np.int64)
        ends, link = np.full(count, -1, np.int64), np.zeros(count, np.int64)
        ends[final] = np.arange(len(literals))
        at = 1
        if levels:
            step[0, classes[levels[0][1]]] = np.arange(1, 1 + len(levels[0][0]))
        for depth, (parent, byte) in enumerate(levels):
            nodes = np.arange(at, at + len(parent))
            if depth:
                fail[nodes] = step[fail[parent], classes[byte]]
            step[nodes] = step[fail[nodes]]
            link[nodes] = np.where(ends[fail[nodes]] >= 0, fail[nodes], link[fail[nodes]])
            at += len(parent)
            if depth + 1 < len(levels):
                below, letter = levels[depth + 1]
                step[below, classes[letter]] = np.arange(at, at + len(below))
        # States in which something ends come last, and transitions hold the place of a state's row.
        some = (ends >= 0) | (link > 0)
        order = np.argsort(some, kind="stable")
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        self.step = (place[step[order]] * width).astype(np.int32).ravel()
        self.ends, self.link = ends[order], np.where(link[order] > 0, place[link[order]], -1)
        self.classes, self.width, self.first = classes, width, int((~some).sum()) * width

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, literal and end (in ``data``) of every occurrence."""
        reach = int(self.length.max()) - 1
        lane = max(LANE, 4 * reach)
        size = np.diff(offsets)
        lanes = -(-size // lane)
        text = np.repeat(np.arange(len(size)), lanes)
        begin = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
        end = np.minimum(begin + lane, offsets[text + 1])
        start = np.maximum(begin - reach, offsets[text])
        order = np.argsort(start - end, kind="stable")  # longest first
        text, begin, start, end = text[order], begin[order], start[order], end[order]
        active = np.searchsorted(start - end, -np.arange(int((end - start).max(initial=0))), "left")
        letters, state, found = self.classes[data].astype(np.int32), np.zeros(len(text), np.int32), []
        for t, n in enumerate(active.tolist()):
            now = self.step[state[:n] + letters[start[:n] + t]]
            state[:n] = now
            hit = np.flatnonzero(now >= self.first)
            if len(hit):
                found.append((hit, now[hit], start[hit] + t + 1))
        if not found:
            return (np.empty(0, np.int64),) * 3
        row, now, place = (np.concatenate(x) for x in zip(*found))
        own = place > begin[row]  # what ends in the overlap belongs to the lane before
        row, now, place = row[own], now[own].astype(np.int64) // self.width, place[own]
        texts, names, places = [], [], []
        while len(now):
            here = self.ends[now] >= 0
            texts.append(text[row[here]])
            names.append(self.ends[now[here]])
            places.append(place[here])
            now = self.link[now]
            more = now >= 0
            row, now, place = row[more], now[more], place[more]
        return np.concatenate(texts), np.concatenate(names), np.concatenate(places)


class Prefixes:
    """A trie with its edges as one sorted array."""

    def __init__(self, literals: list[bytes]):
        levels, final, _ = _levels(literals)
        parent, byte = (np.concatenate(x) for x in zip(*levels))
        edge = parent * 256 + byte
        self.to = np.argsort(edge) + 1
        self.edge = edge[self.to - 1]
        self.ends = np.full(len(edge) + 1, -1)
        self.ends[final] = np.arange(len(literals))

    def longest(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The longest literal that each text starts with, or -1."""
        best = np.full(len(offsets) - 1, -1)
        alive, node, depth = np.arange(len(best)), np.zeros(len(best), np.int64), 0
        while len(alive):
            inside = offsets[alive] + depth < offsets[alive + 1]
            alive, node = alive[inside], node[inside]
            want = node * 256 + data[offsets[alive] + depth]
            at = np.minimum(np.searchsorted(self.edge, want), len(self.edge) - 1)
            same = self.edge[at] == want
            alive, node = alive[same], self.to[at[same]]
            depth += 1
            done = self.ends[node] >= 0
            best[alive[done]] = self.ends[node[done]]
        return best


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``CHUNK`` bytes: first, last, bytes, offsets."""
    data, offsets = _buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def literal_hits(rows: DataFrame, key: str, text: str, literals: DataFrame, literal: str) -> DataFrame:
    """``key, literal, position`` of every occurrence of a listed literal, overlapping ones too; positions count characters from 1."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, literal string, position long"
    context, found = rows.sparkSession.sparkContext, []
    for group in literal_groups(literals, literal, GROUP_BYTES):
        sent = context.broadcast(group)  # of bounded size

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton, names = Automaton(sent.value), pa.array(sent.value, pa.binary()).cast(pa.string())
            for batch in batches:
                for first, last, data, offsets in _chunks(batch[1]):
                    row, which, end = automaton.hits(data, offsets)
                    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    position = before[end - automaton.length[which]] - before[offsets[row]] + 1
                    yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(first + row)), names.take(pa.array(which)), pa.array(position)], [key, "literal", "position"])

        found.append(rows.select(key, text).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)


def contains_any(rows: DataFrame, columns: Sequence[str], literals: DataFrame, literal: str) -> Column:
    """True where one of the text columns of ``rows`` contains a listed literal."""
    context = rows.sparkSession.sparkContext
    texts = [F.col(c).cast("string") for c in columns]
    texts += texts[:1] if len(texts) == 1 else []  # so that one text column comes as a tuple as well
    tests = [_contains(context.broadcast(g))(*texts) for g in literal_groups(literals, literal, GROUP_BYTES)]  # of bounded size
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _contains(sent):
    def test(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        automaton = Automaton(sent.value)
        for batch in batches:
            found = np.zeros(len(batch[0]), bool)
            for column in batch:
                for first, _, data, offsets in _chunks(column):
                    found[first + automaton.hits(data, offsets)[0]] = True
            yield pa.array(found)

    test.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(test, "boolean")


def filter_any_literal(rows: DataFrame, columns: Sequence[str], literals: DataFrame, literal: str) -> DataFrame:
    """Keep rows in which one of ``columns`` contains a literal of the table."""
    return rows.filter(contains_any(rows, columns, literals, literal))


def longest_prefix(rows: DataFrame, column: str, literals: DataFrame, literal: str, name: str = "prefix") -> DataFrame:
    """Add the longest listed literal that a text starts with (null: none)."""
    context = rows.sparkSession.sparkContext
    found = [_longest(context.broadcast(g))(F.col(column).cast("string")) for g in literal_groups(literals, literal, PREFIX_BYTES)]  # of bounded size
    length = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    longer = reduce(lambda a, b: F.when(length(b) > length(a), b).otherwise(a), found, F.lit(None).cast("string"))
    return rows.withColumn(name, longer)


def _longest(sent):
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, names = Prefixes(sent.value), pa.array(sent.value, pa.binary()).cast(pa.string())
        for batch in batches:
            best = trie.longest(*_buffers(batch))
            yield names.take(pa.array(best, mask=best < 0))

    match.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(match, "string")
