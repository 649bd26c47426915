"""Walks over a graph whose result depends on an order of steps or takes very many small rounds, on arrays in one task.

The task never gets an id: nodes come as 64-bit keys, which are checked to be distinct, and
edges as pairs of keys, so that no join is needed to number their ends. In the task an end is
four bytes.
"""

from __future__ import annotations

import tempfile
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20  # entries that are sorted at once
DENSE = 256  # neighbours from which a visit is done on arrays


def keyed(names: DataFrame) -> int:
    """The seed under which the keys of all of ``names(id)`` are distinct; nearly always the first."""
    seed, n = 0, names.count()
    while True:
        k = names.agg(F.count_distinct(key_of("id", seed))).first()[0]
        if k < n and not seed:
            n = names.distinct().count()
        if k == n:
            return seed
        seed += 1


def key_of(c: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), c)


class Keys:
    """Numbers of nodes by their keys."""

    def __init__(self, keys: np.ndarray):
        self.by = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.by]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of ``keys``, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.by[at], np.int32(-1))


def columns(batch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def in_one_task(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the batches of all ``rows``, those of the least ``kind`` first."""
    from codelattice.session import ship

    ship(rows.sparkSession)
    return rows.repartition(1).sortWithinPartitions("kind").mapInArrow(run, schema)


def results(names: list[str], cols: list[np.ndarray]) -> Iterator:
    import pyarrow as pa

    for a in range(0, len(cols[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in cols], names)


# Depth-first


def depth_first(near: np.ndarray, begin: np.ndarray, end: np.ndarray, seeds: list[int], depth: int) -> np.ndarray:
    """Depth of each node of a depth-first crawl that marks nodes when it pushes them, -1 of others.

    The neighbours of a node are ``near[begin:end]`` in their order, each once.
    """
    at = np.full(len(begin), -1, np.int32)
    at[seeds] = 0
    stack = list(reversed(seeds)) if depth > 0 else []
    while stack:
        v = stack.pop()
        x = near[begin[v] : end[v]]
        new = x[at[x] < 0]
        if len(new):
            d = at[v] + 1
            at[new] = d
            if d < depth:  # others would be popped without being gone through
                stack.extend(new.tolist())
    return at


def crawl_in_order(batches, seeds: list[int], depth: int):
    """``key, depth`` from rows ``kind, a, b``: 0 for nodes (key), 1 for neighbours (both keys), those of a node together and in order.

    Neighbours wait in a file, so memory holds the nodes only.
    """
    keys: list[np.ndarray] = []
    with tempfile.TemporaryFile() as kept:
        us, counts, n = [], [], 0
        for batch in batches:
            kind, a, b = columns(batch)
            keys.append(a[kind == 0])
            u = a[kind == 1]
            if len(u):
                kept.write(np.ascontiguousarray(b[kind == 1]))
                first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                us.append(u[first])
                counts.append(np.diff(np.r_[first, len(u)]))
                n += len(u)
        all_keys = np.concatenate([*keys, np.empty(0, np.int64)])
        to = Keys(all_keys)
        begin, end = np.zeros(len(all_keys), np.int64), np.zeros(len(all_keys), np.int64)
        if n:
            kept.flush()
            raw = np.memmap(kept, np.int64, "r", shape=(n,))
            u, size = to.find(np.concatenate(us)), np.concatenate(counts)
            until = np.cumsum(size)
            # A node that goes on in the next batch is there twice, one part after the other.
            np.maximum.at(end, u, until)
            begin[:] = n
            np.minimum.at(begin, u, until - size)
            with tempfile.TemporaryFile() as numbers:
                for x in range(0, n, CHUNK):
                    numbers.write(to.find(raw[x : x + CHUNK]))
                numbers.flush()
                at = depth_first(np.memmap(numbers, np.int32, "r", shape=(n,)), np.minimum(begin, end), end, to.find(np.array(seeds, np.int64)).tolist(), depth)
        else:
            at = depth_first(np.empty(0, np.int32), begin, end, to.find(np.array(seeds, np.int64)).tolist(), depth)
    met = np.flatnonzero(at >= 0)
    yield from results(["key", "depth"], [all_keys[met], at[met]])


# Communities in rounds


_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def hashed_on(h: np.ndarray, k: int) -> np.ndarray:
    """``xxhash64(label, k)`` for an int ``k``, from ``h = xxhash64(label)``."""
    x = h.view(np.uint64) + (_P5 + np.uint64(4))
    x ^= np.uint64(k * int(_P1) % 2**64)
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * _P2 + _P3
    x ^= x >> np.uint64(33)
    x *= _P2
    x ^= x >> np.uint64(29)
    x *= _P3
    x ^= x >> np.uint64(32)
    return x.view(np.int64)


def round_moves(n: int, s: np.ndarray, d: np.ndarray, w: np.ndarray, m: int, h: np.ndarray, rise: float, look: int) -> tuple[np.ndarray, float]:
    """Community (a node's number) of each of ``n`` nodes at which moves end, and its modularity.

    Gains are compared as whole numbers, times ``m``, which gives the same order as rounding
    them to nine decimals up to 500,000,000 edges.
    """
    o = np.bincount(s, w, n).astype(np.int64)
    i = np.bincount(d, w, n).astype(np.int64)
    ends = np.flatnonzero((o > 0) | (i > 0))  # others stay alone
    apart = s != d
    other, weight, ptr = _both_ways(n, s[apart], d[apart], w[apart])
    com = np.arange(n, dtype=np.int64)
    still, r, reached = 0, 0, -1.0
    cuts = _cuts(ptr, n)
    while True:
        co, ci = np.bincount(com, o, n).astype(np.int64), np.bincount(com, i, n).astype(np.int64)
        best = com.copy()
        for a, b in cuts:
            own = np.arange(a, b)
            # Where a node is counts as a choice, too, even without links to it.
            ids = np.concatenate([np.repeat(own, np.diff(ptr[a : b + 1])), own]) - a
            key = ids * n + np.concatenate([com[other[ptr[a] : ptr[b]]], com[a:b]])
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            links = np.add.reduceat(np.concatenate([weight[ptr[a] : ptr[b]], np.zeros(b - a, weight.dtype)])[order], first, dtype=np.int64)
            v, c = np.divmod(key[first], n)
            stay, ov, iv = c == com[v + a], o[v + a], i[v + a]
            gain = links * m - (ov * (ci[c] - stay * iv) + iv * (co[c] - stay * ov))
            start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            most = gain == np.repeat(np.maximum.reduceat(gain, start), np.diff(np.r_[start, len(v)]))
            last = np.maximum.reduceat(np.where(most, c, -1), start)
            best[a:b] = np.where(np.logical_or.reduceat(most & stay, start), com[a:b], last)
        k = hashed_on(h, r // 2)
        turn = k[best] < k[com]  # nobody swaps places
        turn = turn if r % 2 == 0 else ~turn
        moved = bool(np.any((turn & (best != com))[ends]))
        com, r = np.where(turn, best, com), r + 1
        still = 0 if moved else still + 1
        if still == 2 or r % look == 0:
            co, ci = np.bincount(com, o, n), np.bincount(com, i, n)
            q = float(w[com[s] == com[d]].sum(dtype=np.int64)) / m - float(np.dot(co, ci)) / m**2
            if still == 2 or q <= reached + rise:
                return com, q
            reached = q


def _cuts(ptr: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Ranges of nodes with about CHUNK entries, at least one node each."""
    out, a = [], 0
    load = ptr + np.arange(n + 1)
    while a < n:
        b = max(a + 1, int(np.searchsorted(load, load[a] + CHUNK, "right")) - 1)
        out.append((a, min(b, n)))
        a = out[-1][1]
    return out


def _both_ways(n: int, s: np.ndarray, d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbour and weight of each entry, by node, and where the entries of a node begin."""
    ends = np.concatenate([s, d])
    order = np.argsort(ends, kind="stable")
    ptr = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
    return np.concatenate([d, s])[order], np.concatenate([w, w])[order], ptr


def rounds(n: int, s: np.ndarray, d: np.ndarray, w: np.ndarray, m: int, h: np.ndarray, reached: float, rise: float, look: int) -> np.ndarray:
    """Community of each node after all levels, as the number of its least member."""
    member, label = np.arange(n), np.arange(n)  # a level's node of each node, and its label
    while True:
        size = len(label)
        com, q = round_moves(size, s, d, w, m, h[label], rise, look)
        if q <= reached + rise:
            _, least, at = np.unique(member, return_index=True, return_inverse=True)
            return least[at]
        reached = q
        left, inner = np.unique(com, return_inverse=True)
        member, label = inner[member], label[left]
        pair, at = np.unique(inner[s].astype(np.int64) * len(left) + inner[d], return_inverse=True)
        w = np.bincount(at, w).astype(np.int32)
        s, d = (x.astype(np.int32) for x in np.divmod(pair, len(left)))


def rounds_of_rows(batches, m: int, reached: float, rise: float, look: int):
    """``pos, community`` from rows ``kind, pos, a, b, w``: 0 for nodes (place in order, key, hash of the id), 1 for edges (keys, weight)."""
    n, (s, d), rest = _read(batches, {"h": 3}, {"w": 4})
    if len(s) and min(s.min(), d.min()) < 0:
        raise ValueError("an edge ends at no node")
    com = rounds(n, s, d, rest["w"].astype(np.int32), m, rest["h"], reached, rise, look)
    yield from results(["pos", "community"], [np.arange(n, dtype=np.int32), com.astype(np.int32)])


def _read(batches, of_nodes: dict[str, int], of_edges: dict[str, int]) -> tuple[int, list[np.ndarray], dict[str, np.ndarray]]:
    """Count of nodes, ends of edges as places, further columns of both, from rows ``kind, pos, a, b, ...`` in order of ``kind``."""
    nodes: list[list[np.ndarray]] = []
    edges: list[list[np.ndarray]] = []
    keys = None
    for batch in batches:
        cols = columns(batch)
        e = cols[0] == 1
        if not e.all():
            nodes.append([cols[1][~e], cols[2][~e], *[cols[k][~e] for k in of_nodes.values()]])
        if e.any():
            keys = keys or _keys(nodes)
            edges.append([keys.find(cols[2][e]), keys.find(cols[3][e]), *[cols[k][e].astype(np.int32) for k in of_edges.values()]])
    pos = np.concatenate([x[0] for x in nodes]) if nodes else np.empty(0, np.int32)
    rest: dict[str, np.ndarray] = {}
    for k, name in enumerate(of_nodes):
        rest[name] = np.empty(len(pos), np.int64)
        for x in nodes:
            rest[name][x[0]] = x[2 + k]
    joined = [np.concatenate([x[k] for x in edges]) if edges else np.empty(0, np.int32) for k in range(2 + len(of_edges))]
    return len(pos), joined[:2], rest | dict(zip(of_edges, joined[2:]))


def _keys(nodes: list[list[np.ndarray]]) -> Keys:
    keys = np.empty(sum(len(x[0]) for x in nodes), np.int64)
    for x in nodes:
        keys[x[0]] = x[1]
    return Keys(keys)


# Communities in sequence


def sequential(n: int, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Community of each of ``n`` nodes: local moves from a queue until none gains, communities become nodes, and again."""
    seed = 123456789
    m, size, member = float(len(s)), n, np.arange(n)
    s, d, w = _merged(n, s, d, np.ones(len(s)))
    while m:
        seed = (seed * 9301 + 49297) % 233280
        com = _visits(size, s, d, w, m, int(seed / 233280 * size))
        if com is None:
            break
        inner, count = _in_order_met(com)
        member, size = inner[member], count
        s, d, w = _merged(size, inner[s], inner[d], w)
    return _in_order_met(member)[0]


def _in_order_met(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Values numbered as they are met first, and how many there are."""
    found, first, inverse = np.unique(x, return_index=True, return_inverse=True)
    rank = np.empty(len(found), np.int32)
    rank[np.argsort(first, kind="stable")] = np.arange(len(found), dtype=np.int32)
    return rank[inverse], len(found)


def _merged(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order they are met first, with the sums of their weights."""
    key = a.astype(np.int64) * n + b
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    sums = np.add.reduceat(w[order], start) if len(key) else w
    first, key = order[start], key[start]
    del order
    met = np.argsort(first)
    a, b = np.divmod(key[met], n)
    return a.astype(np.int32), b.astype(np.int32), sums[met]


def _visits(size: int, s: np.ndarray, d: np.ndarray, w: np.ndarray, m: float, start: int) -> np.ndarray | None:
    """Communities after the visits of a level; None if no node moved."""
    out_, into_ = np.bincount(s, w, size), np.bincount(d, w, size)
    apart = s != d
    # Neighbours in the order their first edge, either way, is met.
    ends = np.stack([s[apart], d[apart]], 1).ravel()
    u, v, x = _merged(size, ends, np.stack([d[apart], s[apart]], 1).ravel(), np.repeat(w[apart], 2))
    del ends, apart
    order = np.argsort(u, kind="stable")
    ptr = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=size))])
    v, x = v[order], x[order]
    del u, order
    near, weights, begin = memoryview(np.ascontiguousarray(v)), memoryview(np.ascontiguousarray(x)), memoryview(ptr)
    com, co, ci, out, into = array("i", range(size)), array("d", out_), array("d", into_), array("d", out_), array("d", into_)
    com_, co_, ci_ = np.frombuffer(com, np.int32) if size else None, np.frombuffer(co), np.frombuffer(ci)
    waiting, moved = bytearray(b"\1" * size), False
    waits = np.frombuffer(waiting, np.uint8)
    queue = deque((start + k) % size for k in range(size))
    while queue:
        at = queue.popleft()
        waiting[at] = 0
        own, a, b = com[at], begin[at], begin[at + 1]
        o, i = out[at], into[at]
        co[own] -= o
        ci[own] -= i
        if b - a < DENSE:
            shared = {own: 0.0}
            here = near[a:b].tolist()
            for u, y in zip(here, weights[a:b].tolist()):
                c = com[u]
                shared[c] = shared.get(c, 0.0) + y
            best, most = own, shared[own] - (o * ci[own] + i * co[own]) / m
            limit = most + 1e-12
            for c, y in shared.items():
                gain = y - (o * ci[c] + i * co[c]) / m
                if gain > limit:
                    best, limit = c, gain + 1e-12
        else:
            there = com_[v[a:b]]
            found, first, inverse = np.unique(there, return_index=True, return_inverse=True)
            y = np.bincount(inverse, x[a:b])
            gains = y - (o * ci_[found] + i * co_[found]) / m
            is_own = found == own
            shared_own = float(y[is_own][0]) if is_own.any() else 0.0
            best, most = own, shared_own - (o * ci[own] + i * co[own]) / m
            met = np.argsort(first)
            found, gains = found[met], gains[met]
            while len(better := np.flatnonzero(gains > most + 1e-12)):
                k = better[0]
                best, most = int(found[k]), float(gains[k])
                found, gains = found[k + 1 :], gains[k + 1 :]
        co[best] += o
        ci[best] += i
        if best != own:
            com[at], moved = best, True
            if b - a < DENSE:
                for u in here:
                    if com[u] != best and not waiting[u]:
                        waiting[u] = 1
                        queue.append(u)
            else:
                u = v[a:b]
                u = u[(com_[u] != best) & (waits[u] == 0)]
                waits[u] = 1
                queue.extend(u.tolist())
    return com_.copy() if moved else None


def sequence_of_rows(batches):
    """``pos, community`` from rows ``kind, pos, a, b``: 0 for nodes (place by code point, key, rank in locale order), 1 for edges (keys)."""
    n, (s, d), rest = _read(batches, {"rank": 3}, {})
    known = (s >= 0) & (d >= 0)
    s, d = s[known], d[known]
    rank = rest["rank"].astype(np.int32)
    order = np.lexsort((d, s, rank[d], rank[s]))
    com = sequential(n, s[order], d[order])
    yield from results(["pos", "community"], [np.arange(n, dtype=np.int32), com.astype(np.int32)])
