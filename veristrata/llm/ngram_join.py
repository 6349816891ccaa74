"""N-gram Jaccard join by T-occurrence search.

Two documents link if den * |A and B| >= num * |A or B| for their sets of word shingles, by a rule that names num, den and the words.
Documents with equal sets are one node.

Routing without loss. Shingles are put in one order: those that were seen often come last, the others by their hashes. (The order is
the same for all sets; any such order is right, and a better count only makes it faster.) Linked sets of n and m shingles share
enough of them for their prefixes, the first n - least(n) + 1 in that order, to have one in common. Prefix shingles are the routing
keys: keys that one node has alone are dropped after the shuffle, and keys with the same nodes are one group. In a group, pairs are
tried by their sizes and by bitmaps of parities (a shingle flips one; so the sets differ in at least as many shingles as their
bitmaps differ in bits), which keeps every pair that links. What passes hangs together in a block. A group of very many nodes is not
gathered: nodes that pass with its leader are in the leader's block, and only the others meet each other and the rest, part by part.

Search. In a block, an inverted index is built. Some pivots, nodes whose lists are long, are counted against the whole index, which
joins near copies to a few components. Then each node's search leaves out its own component's part of every list, merges the short
rests by a heap, keeps nodes found at least T - L times, and probes its L longest rests by binary search for these (DivideSkip),
with T from the pair's sizes. All links between components are found; links inside one aren't counted. A block beyond a bound on its
postings is searched in parts, each with the block's leaders; then the pairs of its groups that pass between different components
make new blocks, which hold far fewer nodes. Should one of these be too large again, the nodes outside its largest component are
searched against each other and against that component, part by part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import _shared, _text as T


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the similarity num / den from which two sets link: num * union <= den * intersection."""

    words: int = 4
    num: int = 85
    den: int = 100

    def least(self, n):
        """The fewest shingles that a set must share, and have, to link with one of n."""
        return -(-self.num * n // self.den)

    def shared(self, n, m):
        """The fewest shingles that sets of n and m must share to link."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def alone(self, n):
        """Whether sets of n shingles can link with equal sets only."""
        return (self.least(n) == n) & (self.den * n // self.num == n)


#: Four words and 0.85; near-duplicate stages take five words and 0.8.
RULE, NEAR = Rule(), Rule(5, 80, 100)
#: Bits of the smallest bitmaps; sets of more shingles have the next power of two.
LEAST_BITS = 512
#: Edges that one task joins by itself.
CONTRACTED = 500_000
#: Shingles of distinct sets that a map task counts at once; how often one must be met there, and in all, to be put last; and the most such shingles.
COUNTED, SEEN, OFTEN, MOST_OFTEN = 1_000_000, 3, 16, 1 << 18
#: Nodes of a group that one task gathers.
GROUP = 4_096
#: Postings of a block that one task searches at once, and the nodes that every part of a larger one holds.
BLOCK_POSTINGS, LEADERS = 2_000_000, 16
#: Pivots of a block, and postings that are merged by a heap (more are merged by a sort).
PIVOTS, HEAPED = 64, 4_096
#: Names that a map task remembers, so as not to send them twice.
REMEMBERED = 1_000_000


def nodes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set; empty sets have 0."""
    size = np.diff(at)
    name = T.mix(T.summed(T.mix(sets ^ T.RUN[0]), at) + size.astype(np.uint64) * T.RUN[1]).view(np.int64)
    name[size == 0] = 0
    return name


def bitmaps(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The parities of the shingles that fall on each bit, for each set; a wide bitmap's halves make the narrower one by exclusive or."""
    size = np.diff(at)
    width = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(width)])
    place = (T.mix(sets ^ T.RUN[2]) & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(to[:-1], size) + place, minlength=to[-1]).astype(np.uint8) & 1
    raw, ends = np.packbits(odd, bitorder="little").tobytes(), (to // 8).tolist()
    return [raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


class Bitmaps:
    """Sizes and bitmaps of some sets, in a matrix for each width."""

    def __init__(self, size: np.ndarray, bits: list[bytes], rule: Rule):
        self.size, self.rule = size.astype(np.int64), rule
        words = np.array([len(b) // 8 for b in bits], np.int64)
        self.level = np.log2(np.maximum(words, 1)).astype(np.int64)
        self.row = np.zeros(len(bits), np.int64)
        self.matrix = {}
        for level in np.unique(self.level).tolist():
            own = np.flatnonzero(self.level == level)
            self.row[own] = np.arange(len(own))
            self.matrix[level] = np.frombuffer(b"".join([bits[i] for i in own.tolist()]), np.uint64).reshape(len(own), -1)

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the i-th sets may link with the j-th ones, by sizes and bitmaps; true for all that do."""
        a, b = self.size[i], self.size[j]
        most = a + b - 2 * self.rule.shared(a, b)
        out = (np.abs(a - b) <= most) & (np.minimum(a, b) >= self.rule.least(np.maximum(a, b)))
        kept = np.flatnonzero(out)
        i, j = i[kept], j[kept]
        high, low = np.maximum(self.level[i], self.level[j]), np.minimum(self.level[i], self.level[j])
        for level in np.unique(low).tolist():
            for above in (level, level + 1):  # sizes that pass are never further apart
                pair = np.flatnonzero((low == level) & (high == above))
                if not len(pair):
                    continue
                x, y = (np.where(self.level[i[pair]] >= self.level[j[pair]], k, m) for k, m in ((i[pair], j[pair]), (j[pair], i[pair])))
                wide, narrow = self.matrix[above][self.row[x]], self.matrix[level][self.row[y]]
                if above > level:
                    half = wide.shape[1] // 2
                    wide = wide[:, :half] ^ wide[:, half:]
                out[kept[pair]] = np.bitwise_count(wide ^ narrow).sum(axis=1, dtype=np.int64) <= most[kept[pair]]
        return out


class Order:
    """The common order of shingles: `often` (sorted) come last, by `rank`; the others come first, by their hashes."""

    def __init__(self, shingles: np.ndarray, times: np.ndarray):
        by_hash = np.argsort(shingles)
        self.often = shingles[by_hash]
        self.rank = np.empty(len(by_hash), np.int32)
        self.rank[np.lexsort((self.often, times[by_hash]))] = np.arange(1, len(by_hash) + 1)

    def prefixes(self, sets: np.ndarray, at: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """The prefix of each set (given in order of hashes), and the row of each of its shingles; sets that link with none have none."""
        size = np.diff(at)
        row = np.repeat(np.arange(len(size)), size)
        if len(self.often) and len(sets):
            spot = np.minimum(np.searchsorted(self.often, sets), len(self.often) - 1)
            rank = np.where(self.often[spot] == sets, self.rank[spot], 0)
            sets = sets[np.lexsort((rank, row))]  # stable: hashes stay in order where ranks are equal
        wanted = np.where((size == 0) | rule.alone(size), 0, size - rule.least(size) + 1)
        keep = np.arange(len(sets)) - at[:-1][row] < wanted[row]
        return sets[keep], row[keep]


class Union:
    """Components over 0 .. n - 1."""

    def __init__(self, top: list[int]):
        self.top = top

    def find(self, i: int) -> int:
        top = self.top
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.top[max(i, j)] = min(i, j)
        return i != j

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.top))], np.int64)


def crossing(own: Bitmaps, begin: int, end: int, label: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs from begin to end that pass and have different labels, enough to connect all nodes that have one, directly or through others."""
    union, out = Union(list(range(end - begin))), []
    for i in range(begin + 1, end):
        other = begin + np.flatnonzero(label[begin:i] != label[i])
        for j in other[own.passing(np.full(len(other), i), other)].tolist():
            if union.join(i - begin, j - begin):
                out.append((i, j))
    return out


def hanging(own: Bitmaps, begin: int, end: int, inside: np.ndarray) -> list[tuple[int, int]]:
    """Pairs from begin to end that pass and connect all nodes that pass directly or through others. Nodes that are `inside` hang together already."""
    within = np.flatnonzero(inside[begin:end])
    first = int(within[0]) if len(within) else 0
    union, out = Union([first if x else i for i, x in enumerate(inside[begin:end].tolist())]), []
    every = np.arange(begin, end)
    skip = inside[begin:end].copy()
    if not len(within):  # the first node's near ones hang on it; what they pass with is tried from the others' side
        skip = own.passing(np.full(len(every), begin), every)
        skip[0] = False
    for i in every[~skip].tolist():
        for j in every[own.passing(np.full(len(every), i), every)].tolist():
            if j != i and union.join(i - begin, j - begin):
                out.append((i, j))
    return out


def search(sets: list[np.ndarray], rule: Rule = RULE, label: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all sets which link directly or through others; a spanning part of all links.

    Sets with an equal label count as connected. Sets are distinct and not empty.
    """
    n = len(sets)
    order = sorted(range(n), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    tokens, token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    token, owner = token.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), size)
    lists, list_at = owner[np.argsort(token, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens)))])
    length = np.diff(list_at).astype(np.int32)
    first: dict[int, int] = {}
    union, links = Union([first.setdefault(label[i], k) for k, i in enumerate(order)] if label else list(range(n))), []

    def linked(q: int, others: list[int]) -> int:
        made = [c for c in others if union.join(q, c)]
        links.extend((order[q], order[c]) for c in made)
        return len(made)

    # pivots: the nodes with the longest lists that aren't in the largest component, as long as that pays
    weight = np.add.reduceat(length[token], at[:-1], dtype=np.int64)
    tried, idle = np.zeros(n, bool), 0
    for _ in range(min(PIVOTS, n)):
        component = union.labels()
        outside = ~tried & (component != np.bincount(component).argmax()) if tried.any() or label else ~tried
        if idle == 4 or not outside.any():
            break
        q = int(np.where(outside, weight, -1).argmax())
        tried[q] = True
        found = np.bincount(np.concatenate([lists[list_at[t] : list_at[t + 1]] for t in token[at[q] : at[q + 1]].tolist()]), minlength=n)
        found[q] = 0
        idle = 0 if linked(q, np.flatnonzero(found >= rule.shared(size[q], size)).tolist()) else idle + 1

    component = union.labels().astype(np.int32)
    by_component = np.lexsort((owner, component[owner], token)).astype(np.int32)
    lists = owner[by_component]
    # the part of each list that belongs to one component, and for each posting where its own component's part begins and ends
    parts = np.flatnonzero(np.concatenate([[True], (np.diff(token[by_component]) != 0) | (np.diff(component[lists]) != 0)])).astype(np.int32)
    part_of = np.empty(len(lists), np.int32)
    part_of[by_component] = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(np.append(parts, len(lists))))
    begin, end = parts[part_of], np.append(parts, np.int32(len(lists)))[part_of + 1]
    rest = length[token] - (end - begin)
    several = np.add.reduceat((rest > 0).astype(np.int64), at[:-1])
    for q in np.flatnonzero((several >= rule.least(size)) & ~tried).tolist():
        needed = int(rule.least(size[q]))
        own = []
        for p in (at[q] + np.flatnonzero(rest[at[q] : at[q + 1]])).tolist():
            t = token[p]
            row = np.concatenate([lists[list_at[t] : begin[p]], lists[end[p] : list_at[t + 1]]])
            row = row[(size[row] >= needed) & (row < q) & ~tried[row]]  # each pair once
            if len(row):
                own.append(np.sort(row))
        if len(own) < needed:
            continue
        own.sort(key=len)
        many = min(needed - 1, int(needed / (0.0085 * np.log2(len(own[-1]) + 1) + 1)))
        short, long = own[: len(own) - many], own[len(own) - many :]
        if sum(map(len, short)) <= HEAPED:
            counted = [(x, sum(1 for _ in same)) for x, same in groupby(heapq.merge(*(r.tolist() for r in short)))]
            candidate, count = (np.array(x, np.int64) for x in zip(*counted, strict=True))
        else:
            candidate, count = np.unique(np.concatenate(short), return_counts=True)
        enough = count >= max(1, needed - many)
        candidate, count = candidate[enough], count[enough]
        wanted = rule.shared(size[q], size[candidate])
        for i, row in enumerate(long[::-1]):
            alive = count + (len(long) - i) >= wanted
            candidate, count, wanted = candidate[alive], count[alive], wanted[alive]
            if not len(candidate):
                break
            spot = np.minimum(np.searchsorted(row, candidate), len(row) - 1)
            count = count + (row[spot] == candidate)
        linked(q, candidate[count >= wanted].tolist())
    return links


def text_key(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text)


def shingle_nodes(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, text_key (a hash of the text), node, n_shingles, bits of each row of docs(doc_id, text); beside them, rows without a
    node: shingles that were met often in some part of the rows, and how often."""
    names = ["doc_id", "text_key", "node", "n_shingles", "bits", "shingle", "times"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: list[np.ndarray] = []

        def often(kind: pa.DataType) -> pa.RecordBatch:
            shingle, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            keep = times >= SEEN
            n = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary()), pa.array(shingle[keep].view(np.int64)), pa.array(times[keep])], names)

        kind = None
        for part, data, at in T.pieces(batches, "text"):
            kind = part["doc_id"].type
            sets, to = T.shingle_sets(data, at, rule.words)
            name, n = nodes(sets, to), part.num_rows
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(name), pa.array(np.diff(to)), pa.array(bitmaps(sets, to), pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
            if len(met) > REMEMBERED:
                met.clear()
            for i, x in enumerate(name.tolist()):
                if x not in met:
                    met.add(x)
                    held.append(sets[to[i] : to[i + 1]])
            if sum(map(len, held)) >= COUNTED:
                yield often(kind)
        if held:
            yield often(kind)

    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(T.thrifty(named), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, node long, n_shingles long, bits binary, shingle long, times long")


def common_order(counts: DataFrame) -> Order:
    """The order by (shingle, times), at most MOST_OFTEN of which reach the driver and the tasks."""
    counts = counts.groupBy("shingle").agg(F.sum("times").alias("times")).filter(F.col("times") >= OFTEN)
    total = counts.agg(F.sum("times").alias("n")).first()["n"] or 0
    got = counts.filter(F.col("times") > total // MOST_OFTEN).toArrow()
    return Order(got["shingle"].to_numpy().view(np.uint64), got["times"].to_numpy())


def groups(docs: DataFrame, order: Order, rule: Rule = RULE) -> DataFrame:
    """(group, node, large): nodes that have a routing key in common; large groups are those of more than GROUP nodes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for _, data, at in T.pieces(batches, "text"):
            sets, to = T.shingle_sets(data, at, rule.words)
            name = nodes(sets, to)
            key, row = order.prefixes(sets, to, rule)
            new = np.zeros(len(name), bool)
            for i, x in enumerate(name.tolist()):
                if x not in met:
                    new[i] = True
                    met.add(x)
            if len(met) > REMEMBERED:
                met.clear()
            keep = new[row]
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(name[row[keep]])], ["key", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and node. The last key's nodes wait for the next batch, unless they are very many already."""
        last_key, last_node, large = None, None, None
        wait = np.zeros((2, 0), np.int64)
        met: set[int] = set()

        def made(key: np.ndarray, node: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal wait, large
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            big = (size > GROUP) | (key[begin] == large if large is not None else False)
            end = len(key)
            if not last:
                if big[-1]:
                    large = key[-1]
                else:
                    end = begin[-1]
                    begin, size, big = begin[:-1], size[:-1], big[:-1]
            wait = np.stack([key[end:], node[end:]])
            if not len(begin):
                return
            name = T.mix(T.summed(T.mix(node[:end].view(np.uint64) ^ T.RUN[3]), np.append(begin, end)) + size.astype(np.uint64)).view(np.int64)
            name[big] = T.mix(key[begin[big]].view(np.uint64) + T.RUN[2]).view(np.int64)
            if len(met) > REMEMBERED:
                met.clear()
            keep = big.copy()
            for i in np.flatnonzero((size > 1) & ~big).tolist():
                if (x := int(name[i])) not in met:
                    met.add(x)
                    keep[i] = True
            row = np.repeat(keep, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[row]), pa.array(node[:end][row]), pa.array(np.repeat(big, size)[row])], ["group", "node", "large"])

        for part in batches:
            key, node = part["key"].to_numpy(), part["node"].to_numpy()
            if not len(key):
                continue
            new = np.concatenate([[key[0] != last_key or node[0] != last_node], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            last_key, last_node = key[-1], node[-1]
            if new.any():
                yield from made(np.concatenate([wait[0], key[new]]), np.concatenate([wait[1], node[new]]), False)
        if wait.shape[1]:
            yield from made(wait[0], wait[1], True)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").mapInArrow(T.thrifty(keyed), "key long, node long")
    return rows.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(T.thrifty(shared), "group long, node long, large boolean").distinct()


def paired(rows: DataFrame, group: str, inside: str, most: int, size=None) -> DataFrame:
    """rows with `unit`: copies such that any two rows of a group that aren't both inside meet in a unit.

    Both sides of a group are dealt to parts of about `most` rows (or of that sum of `size`); a unit has two parts, the first of them from outside. Nothing is
    gathered: totals are counted and joined back. A group with nothing outside has no unit.
    """
    size = F.lit(1) if size is None else size
    share = lambda cond: F.coalesce(F.ceil(F.sum(F.when(cond, size)) / max(1, most // 2)), F.lit(0))
    totals = rows.groupBy(F.col(group).alias("__g")).agg(share(~F.col(inside)).alias("__out"), share(F.col(inside)).alias("__in"))
    rows = rows.join(totals.filter("__out > 0"), F.col(group) == F.col("__g"))
    part = F.pmod(F.xxhash64("node", F.lit(5)), F.when(F.col(inside), F.col("__in")).otherwise(F.col("__out")))
    outside = F.sequence(F.lit(0).cast("long"), F.col("__out") - 1)
    unit = lambda i, j, kind: F.xxhash64("__g", i, j, F.lit(kind))
    own = F.when(F.col(inside), F.transform(outside, lambda k: unit(k, part, 1))).otherwise(
        F.concat(F.transform(outside, lambda k: unit(F.least(k, part), F.greatest(k, part), 0)), F.when(F.col("__in") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("__in") - 1), lambda k: unit(part, k, 1))).otherwise(F.array().cast("array<bigint>")))
    )
    return rows.withColumn("unit", F.explode(own)).drop("__g", "__out", "__in")


def candidates(grouped: DataFrame, known: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Edges (a, b) between nodes of a group that may link, enough to connect all that may; known: node, n_shingles, bits.

    If known has a `label` too, only nodes of different labels count.
    """
    spark = grouped.sparkSession
    parts, labelled = int(spark.conf.get("spark.sql.shuffle.partitions")), "label" in known.columns
    rows = grouped.join(known if labelled else known.withColumn("label", F.col("node")), "node")
    if labelled:
        mixed = rows.groupBy("group").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l != m").select("group")
        rows = _shared.settle(rows.join(mixed, "group", "left_semi"), "ngram-mixed")
    columns = ["group", "node", "n_shingles", "bits", "label", "top"]

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if labelled:
                inside = part["label"].to_numpy() == part["top_label"].to_numpy()
            else:
                n = part.num_rows
                own = Bitmaps(np.concatenate([part["n_shingles"].to_numpy(), part["top_n"].to_numpy()]), part["bits"].to_pylist() + part["top_bits"].to_pylist(), rule)
                inside = own.passing(np.arange(n), n + np.arange(n))
            yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(inside)], [*columns, "inside"])

    def hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; a unit's rows are few enough to be held."""
        wait = None

        def made(table: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            nonlocal wait
            unit = table["unit"].to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            if not last:
                wait = table.slice(int(begin[-1]))
                table, begin = table.slice(0, int(begin[-1])), begin[:-1]
            at = np.append(begin, table.num_rows)
            node, label, inside = table["node"].to_numpy(), table["label"].to_numpy(), table["inside"].to_numpy(zero_copy_only=False).astype(bool)
            own = Bitmaps(table["n_shingles"].to_numpy(), table["bits"].to_pylist(), rule)
            top = np.repeat(begin, np.diff(at))
            # most units are decided by their first node: all pass with it, or there are only two
            near = own.passing(np.arange(len(node)), top)
            far = np.bincount(np.repeat(np.arange(len(begin)), np.diff(at))[~near], minlength=len(begin)) > 0
            easy = (np.diff(at) == 2) if labelled else ~far | (np.diff(at) == 2)
            plain = np.repeat(easy, np.diff(at)) & near & (np.arange(len(node)) != top) & ((label != label[top]) | (not labelled))
            a, b = [node[plain]], [node[top[plain]]]
            for i in np.flatnonzero(~easy & (np.diff(at) > 2)).tolist():
                got = crossing(own, at[i], at[i + 1], label) if labelled else hanging(own, at[i], at[i + 1], inside)
                got = np.array(got, np.int64).reshape(-1, 2)
                a.append(node[got[:, 0]])
                b.append(node[got[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        for part in batches:
            if part.num_rows:
                part = part if wait is None else pa.Table.from_batches([wait, part]).combine_chunks().to_batches()[0]
                yield made(part, False)
        if wait is not None and wait.num_rows:
            yield made(wait, True)

    test = lambda r: r.select("unit", "node", "n_shingles", "bits", "label", "inside").repartition(parts, "unit").sortWithinPartitions("unit", "node").mapInArrow(T.thrifty(hung), "a long, b long")
    out = test(rows.filter("not large").withColumn("unit", F.col("group")).withColumn("inside", F.lit(False)))
    if not rows.filter("large").isEmpty():
        large = rows.filter("large").drop("large")
        top = lambda c: F.col(f"t.{c}")
        tops = large.groupBy("group").agg(F.min(F.struct("node", "n_shingles", "bits", "label")).alias("t")).select("group", top("node").alias("top"), top("n_shingles").alias("top_n"), top("bits").alias("top_bits"), top("label").alias("top_label"))
        large = large.join(tops, "group").mapInArrow(T.thrifty(led), "group long, node long, n_shingles long, bits binary, label long, top long, inside boolean")
        large = _shared.settle(large, "ngram-large")
        own = large.filter("inside and node != top").select(F.col("node").alias("a"), F.col("top").alias("b"))
        out = (out if labelled else out.unionByName(own)).unionByName(test(paired(large, "group", "inside", GROUP)))
    return out.distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges from each node to the smallest one that some CONTRACTED edges of its partition connect it to."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            name, place = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            held.clear()
            union = Union(list(range(len(name))))
            for i, j in zip(*place.reshape(2, -1).tolist(), strict=True):
                union.join(i, j)
            label = union.labels()
            kept = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(name[kept]), pa.array(name[label[kept]])], ["a", "b"])

        for part in batches:
            held.append(np.stack([part["a"].to_numpy(), part["b"].to_numpy()]))
            if sum(h.shape[1] for h in held) >= CONTRACTED:
                yield made()
        if held:
            yield made()

    return edges.mapInArrow(T.thrifty(joined), "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): each node of edges(a, b) with the smallest node connected to it; roots themselves have no row.

    Edges are first contracted, CONTRACTED of them to a task; if there are more, alternating large and small stars go on until
    nothing changes. Every round is written to the shared folder, and what it read is deleted. A hot node's neighbours are never
    gathered: minima are pre-aggregated and settled, so that a hot node's rows can be split in the join.
    """
    edges = _shared.settle(edges.select("a", "b").filter("a != b"), name)
    tasks = -(-edges.count() // CONTRACTED)
    after = _shared.settle(contracted(edges.coalesce(max(1, tasks))), name)
    _shared.drop(edges)
    edges, mark = after, None
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _shared.settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = _shared.settle(large, name)
        lower = _shared.settle(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct()
        after = _shared.settle(small, name)
        _shared.drop(edges, least, large, lower)
        edges = after
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def links(docs: DataFrame, known: DataFrame, grouped: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Edges (a, b) between nodes of different sets that link; all links' connections, and only links. known: node, n_shingles, bits, doc_id."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = _shared.settle(known.join(grouped.select("node").distinct(), "node", "left_semi"), "ngram-known")

    def blocks(edges: DataFrame) -> DataFrame:
        """node, n_shingles, doc_id and the root of the block that its edges hang it on."""
        of_block = components(edges, "ngram-blocks")
        of_block = of_block.unionByName(of_block.select(F.col("root").alias("node"), "root").distinct())
        return _shared.settle(of_block.join(known.drop("bits"), "node"), "ngram-members")

    members = blocks(candidates(grouped, known.drop("doc_id"), rule))
    wanted = members.select(F.col("doc_id").alias("__id")).distinct()
    few = wanted.count() <= _shared.SENT_ROWS
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in T.pieces(batches, "text"):
            sets, to = T.shingle_sets(data, at, rule.words)
            raw = sets.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(nodes(sets, to)), pa.array([raw[8 * a : 8 * b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)], pa.binary())], ["node", "shingles"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        unit = None

        def done() -> pa.RecordBatch:
            name = list(held)
            got = search([s for s, _ in held.values()], rule, [c for _, c in held.values()]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([name[i] for i, _ in got], pa.int64()), pa.array([name[j] for _, j in got], pa.int64())], ["a", "b"])

        for part in batches:
            for u, node, label, s in zip(part["unit"].to_pylist(), part["node"].to_pylist(), part["label"].to_pylist(), part["shingles"], strict=True):
                if u != unit:
                    if len(held) > 1:
                        yield done()
                    held, unit = {}, u
                if node not in held:
                    held[node] = np.frombuffer(s.as_buffer(), np.uint64).copy(), label
        if len(held) > 1:
            yield done()

    shingles = texts.mapInArrow(T.thrifty(shingled), "node long, shingles binary")
    find = lambda units: shingles.join(units.select("unit", "node", "label"), "node").repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(T.thrifty(searched), "a long, b long")

    def cut(members: DataFrame) -> DataFrame:
        """root and the number of parts of the blocks that are too large for one task."""
        sizes = members.groupBy("root").agg(F.sum("n_shingles").alias("postings")).filter(F.col("postings") > BLOCK_POSTINGS)
        return _shared.settle(sizes.select("root", F.ceil(F.col("postings") / BLOCK_POSTINGS).alias("parts")), "ngram-cut")

    whole = lambda members, label: members.select("node", F.col("root").alias("unit"), F.col(label).alias("label"))
    large = cut(members)
    if large.isEmpty():
        return find(whole(members, "node")).distinct()
    shingles = _shared.settle(shingles.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "ngram-shingles")
    # large blocks by parts, each with some leaders of the block
    split = members.join(large, "root")
    least = split.groupBy("root").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("node"), F.col("parts")) == 0, F.col("node")))), 1, LEADERS).alias("leaders"))
    split = split.join(least, "root")
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    part = F.when(F.array_contains("leaders", F.col("node")), every).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts"))))
    units = split.select("node", "root", F.explode(part).alias("p")).select("node", F.xxhash64("root", "p").alias("unit"), F.col("node").alias("label"))
    found = _shared.settle(find(whole(members.join(large, "root", "left_anti"), "node").unionByName(units)).distinct(), "ngram-found")
    # then those of their nodes that may link with a node which the parts haven't joined them to: far fewer
    joined = components(found, "ngram-parts").withColumnRenamed("root", "label")
    placed = members.join(large, "root", "left_semi").select("node").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = _shared.settle(placed.join(known, "node"), "ngram-placed")
    rest = blocks(candidates(grouped, placed.select("node", "n_shingles", "bits", "label"), rule)).join(placed.select("node", "label"), "node")
    rest = _shared.settle(rest, "ngram-rest")
    larger = cut(rest)
    found = found.unionByName(find(whole(rest.join(larger, "root", "left_anti"), "label")))
    if larger.isEmpty():
        return found
    # blocks that are still too large: nodes outside their largest component against each other and against that component
    rest = rest.join(larger.select("root"), "root", "left_semi")
    most = rest.groupBy("root", "label").agg(F.sum("n_shingles").alias("n")).groupBy("root").agg(F.max(F.struct("n", "label")).alias("l")).select("root", F.col("l.label").alias("lead"))
    rest = rest.join(most, "root").withColumn("inside", F.col("label") == F.col("lead"))
    return found.unionByName(find(paired(rest, "root", "inside", BLOCK_POSTINGS, F.col("n_shingles"))))


def grouped_documents(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, text_key, n_shingles and `group` of each row of docs(doc_id, text): rows are in one group if links connect them. Rows without shingles have none (null)."""
    _shared.small_batches(docs.sparkSession)
    found = _shared.settle(shingle_nodes(docs, rule), "ngram-nodes")
    named = found.filter("node is not null").select("doc_id", "text_key", "node", "n_shingles", "bits")
    full = named.filter("n_shingles > 0")
    known = full.groupBy("node").agg(F.min("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.min("doc_id").alias("doc_id"))
    grouped = _shared.settle(groups(docs, common_order(found.filter("node is null").select("shingle", "times")), rule), "ngram-groups")
    roots = components(links(docs, known, grouped, rule), "ngram-links")
    _shared.drop(grouped)
    full = full.join(_shared.sent(roots), "node", "left").withColumn("group", F.coalesce("root", "node"))
    columns = ["doc_id", "text_key", "n_shingles", "group"]
    return full.select(columns).unionByName(named.filter("n_shingles = 0").withColumn("group", F.lit(None).cast("long")).select(columns))


def join_documents(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text).

    component_id is the smallest doc_id reachable by links. A null or empty text, or one of white space, has no shingles and is its
    own component. Repeated rows and equal sets are linked. A null doc_id takes part; it never names a component of others. Other
    columns are ignored. An empty table gives no rows.
    """
    rows = _shared.settle(grouped_documents(docs, rule).drop("text_key"), "ngram-grouped")
    full = rows.filter("group is not null")
    least = _shared.settle(full.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "ngram-least")
    linked = full.join(_shared.sent(least.withColumn("several", F.lit(True))), "group", "left")
    linked = linked.select("doc_id", "n_shingles", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return linked.unionByName(rows.filter("group is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def repeated(docs: DataFrame, rule: Rule = NEAR) -> DataFrame:
    """(doc_id, text_key) of the rows of docs that aren't the first of their group: the first has the smallest doc_id, null last, then the smallest text_key."""
    rows = _shared.settle(grouped_documents(docs, rule).filter("group is not null").select("doc_id", "text_key", "group").distinct(), "ngram-grouped")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = _shared.settle(first.select("group", F.col("f.doc_id").alias("__id"), F.col("f.text_key").alias("__key")), "ngram-first")
    return rows.join(_shared.sent(first), "group").filter(~(F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))).select("doc_id", "text_key").distinct()


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
