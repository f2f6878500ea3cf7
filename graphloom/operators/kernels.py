"""Small sequential helpers that grouped tasks run on one bounded graph."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The lower half of a packed link: its target.
LOW = (1 << 32) - 1
#: Packed links that are worked on together.
SOME = 1 << 21

#: What ``component_task`` says of a node, and its type; a component has the type of the ids.
FACTS = {"component": "", "size": "long", "cyclic": "boolean", "rank": "int", "entered": "boolean", "total": "double"}


def strong_components(edges: Iterable[tuple[Hashable, Hashable]]) -> list[list]:
    """Strong components, each after those it depends on."""
    after: dict = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
        after.setdefault(b, after.default_factory())
    order: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    out: list[list] = []
    for root in list(after):
        if root in order:
            continue
        work = [(root, iter(after[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(after[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    part = []
                    while True:
                        member = stack.pop()
                        on.discard(member)
                        part.append(member)
                        if member == node:
                            break
                    out.append(part)
    return out


def coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of columns of one type, sorted, and each column as places among them."""
    both = pa.chunked_array([c for column in columns for c in column.chunks], type=columns[0].type).combine_chunks()
    found = pc.dictionary_encode(both)
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    codes = place[found.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum([len(c) for c in columns])[:-1]
    return found.dictionary.take(pa.array(order)), np.split(codes, ends)


def least_linked(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """For 0 .. n - 1 the least number of its undirected component; ``parent``: those of earlier links, changed in place."""
    if parent is None:
        parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(parent, x, low)
        np.minimum.at(parent, y, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def star_task(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, root) of every ``chunk`` links (source, target) of a task."""

    def fold(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        names, (a, b) = coded(table["source"], table["target"])
        return pa.RecordBatch.from_arrays([names, names.take(pa.array(least_linked(len(names), a, b)))], names=["id", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(h.num_rows for h in held) >= chunk:
                yield fold(held)
                held = []
        if held:
            yield fold(held)

    return run


def component_task(want: tuple[str, ...], chunk: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, *want) of whole undirected components: rows (component, source, target) and, for totals, (component, id, null, w), by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= chunk // 8:  # up to the last component that starts in this batch
                home = batch.column("component")
                first, last = held[-1].column("component")[-1], home[batch.num_rows - 1]
                if first != last:
                    start = pc.index(home, last).as_py()
                    held.append(batch.slice(0, start))
                    yield _facts(pa.Table.from_batches(held), want, most)
                    held, size, batch = [], 0, batch.slice(start)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield _facts(pa.Table.from_batches(held), want, most)

    return run


def _facts(table: pa.Table, want: tuple[str, ...], most: int) -> pa.RecordBatch:
    linked = table.filter(pc.is_valid(table["target"]))
    names, (a, b) = coded(linked["source"], linked["target"])
    n = len(names)
    order = np.argsort(a, kind="stable")
    ends = np.searchsorted(a[order], np.arange(n + 1)).tolist()
    heads = b[order].tolist()
    after = [heads[ends[i] : ends[i + 1]] for i in range(n)]
    parts = _strong(after)  # each after those it depends on
    home = [0] * n
    for i, part in enumerate(parts):
        for node in part:
            home[node] = i
    of = np.array(home, dtype=np.int64)
    out: dict[str, pa.Array] = {}
    if "component" in want:
        out["component"] = names.take(pa.array(np.array([min(p) for p in parts], dtype=np.int64)[of]))
    if "size" in want or "cyclic" in want:
        size = np.array([len(p) for p in parts], dtype=np.int64)[of]
        loop = np.zeros(n, dtype=bool)
        loop[a[a == b]] = True
        out |= {"size": pa.array(size), "cyclic": pa.array((size > 1) | loop)}
    below = [{home[m] for node in part for m in after[node]} - {i} for i, part in enumerate(parts)] if {"rank", "entered", "total"} & set(want) else []
    if "rank" in want:
        rank: list[int] = []
        for under in below:
            rank.append(max((rank[j] for j in under), default=-1) + 1)
        out["rank"] = pa.array(np.array(rank, dtype=np.int32)[of])
    if "entered" in want:
        entered = np.ones(n, dtype=bool)
        entered[b[a != b]] = False
        hit = [bool(entered[p].any()) for p in parts]
        for i in range(len(parts) - 1, -1, -1):
            if hit[i]:
                for j in below[i]:
                    hit[j] = True
        out["entered"] = pa.array(np.array(hit, dtype=bool)[of])
    if "total" in want:
        weighed = table.filter(pc.is_null(table["target"]))
        at = pc.index_in(weighed["source"], value_set=names)
        mass = np.zeros(len(parts))
        np.add.at(mass, of[at.to_numpy()], weighed["w"].to_numpy())
        groups: dict[int, list[int]] = defaultdict(list)
        firsts = np.array([p[0] for p in parts], dtype=np.int64)
        for i, root in enumerate(least_linked(n, a, b)[firsts].tolist()):
            groups[root].append(i)
        totals = np.full(len(parts), np.nan)
        for group in groups.values():
            if len(group) <= most:
                totals[group] = _closure(group, below, mass)
        out["total"] = pa.array(totals[of], from_pandas=True)
    return pa.RecordBatch.from_arrays([names, *[out[c] for c in want]], names=["id", *want])


def _closure(group: list[int], below: list[set[int]], mass: np.ndarray) -> list[float] | np.ndarray:
    """Summed ``mass`` of what each of a component's folded nodes reaches; they come after those they depend on."""
    slot = {i: k for k, i in enumerate(group)}
    if len(group) > 32:
        reached = np.zeros((len(group), len(group)), dtype=bool)
        for k, i in enumerate(group):
            reached[k, k] = True
            for j in below[i]:
                reached[k] |= reached[slot[j]]
        own = mass[group]
        return np.array([own[row].sum() for row in reached])
    sets: list[set[int]] = []
    for i in group:
        own_set = {i}
        for j in below[i]:
            own_set |= sets[slot[j]]
        sets.append(own_set)
    return [sum(float(mass[j]) for j in s) for s in sets]


def _strong(after: list[list[int]]) -> list[list[int]]:
    """Strong components of 0 .. n - 1, each after those it depends on."""
    n = len(after)
    order, low, on, stack, out, count = [-1] * n, [0] * n, [False] * n, [], [], 0
    for root in range(n):
        if order[root] >= 0:
            continue
        work = [(root, iter(after[root]))]
        order[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if order[nxt] < 0:
                    order[nxt] = low[nxt] = count
                    count += 1
                    stack.append(nxt)
                    on[nxt] = True
                    work.append((nxt, iter(after[nxt])))
                    break
                if on[nxt] and order[nxt] < low[node]:
                    low[node] = order[nxt]
            else:
                work.pop()
                if work and low[node] < low[work[-1][0]]:
                    low[work[-1][0]] = low[node]
                if low[node] == order[node]:
                    part = []
                    while True:
                        member = stack.pop()
                        on[member] = False
                        part.append(member)
                        if member == node:
                            break
                    out.append(part)
    return out


def shape_task(count: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The one row of ``shape`` of at most ``count`` packed links; a node is sent as its number below zero, less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, known, at = np.empty(count, dtype=np.int64), np.zeros(width, dtype=bool), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            own = values[values >= 0]
            packed[at : at + len(own)] = own
            at += len(own)
            known[-1 - values[values < 0]] = True
        found = shape(packed[:at], known)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in found.values()], names=list(found))

    return run


def shape(packed: np.ndarray, known: np.ndarray) -> dict[str, int | None]:
    """Number of distinct links between known nodes, greatest fans, strong components with a cycle, nodes of the largest undirected component.

    A link is its source above its target's 32 bits. ``packed`` is overwritten: it is sorted, turned and cut down in place. The strong component of
    a pivot of each undirected component comes first, by two walks; other ones lie among nodes that the same walks met.
    """
    width = len(known)
    packed = _kept(packed, lambda c: known[c >> 32] & known[c & LOW])
    packed.sort()
    last = [-1]

    def fresh(chunk: np.ndarray) -> np.ndarray:
        new = np.diff(chunk, prepend=last[0]) != 0
        last[0] = chunk[-1]
        return new

    packed = _kept(packed, fresh)
    count = len(packed)
    if not count:
        return {"links": 0, "fan_in": None, "fan_out": None, "cycles": 0, "largest": 1}
    ends = _ends(packed, width)
    into, root, loop = np.zeros(width, dtype=np.int32), np.arange(width, dtype=np.int32), np.zeros(width, dtype=bool)
    for c in _chunks(packed):
        a, b = (c >> 32).astype(np.int32), (c & LOW).astype(np.int32)
        into += np.bincount(b, minlength=width).astype(np.int32)
        loop[a[a == b]] = True
        root = least_linked(width, a, b, root)
    fans = {"fan_in": int(into.max()), "fan_out": int(np.diff(ends).max())}
    sizes = np.bincount(root, minlength=width)
    best = np.full(width, -1, dtype=np.int64)
    for start in range(0, width, SOME):
        nodes = np.arange(start, min(start + SOME, width))
        np.maximum.at(best, root[nodes], np.minimum(ends[nodes + 1] - ends[nodes], into[nodes]).astype(np.int64) << 32 | nodes)
    pivots = best[sizes > 1] & LOW
    largest = int(sizes.max())
    del best, sizes, into
    met = _met(pivots, packed, ends)
    for c in _chunks(packed):
        c[:] = (c & LOW) << 32 | c >> 32
    packed.sort()
    ends = _ends(packed, width)
    met |= _met(pivots, packed, ends) << 1
    core = met == 3
    large = np.bincount(root[core], minlength=width) > 1
    within = core & large[root]
    # Turned links have the same strong components.
    packed = _kept(packed, lambda c: (met[c >> 32] == met[c & LOW]) & (met[c & LOW] != 3) & (c >> 32 != c & LOW))
    cycles = int(large.sum()) + _cycles(packed, within)
    return {"links": count, **fans, "cycles": cycles + int((loop & ~within).sum()), "largest": largest}


def _chunks(packed: np.ndarray) -> Iterator[np.ndarray]:
    return (packed[start : start + SOME] for start in range(0, len(packed), SOME))


def _kept(packed: np.ndarray, test: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What passes, moved to the front."""
    at = 0
    for chunk in _chunks(packed):
        chunk = chunk[test(chunk)]
        packed[at : at + len(chunk)] = chunk
        at += len(chunk)
    return packed[:at]


def _ends(packed: np.ndarray, width: int) -> np.ndarray:
    """Where the links of 0 .. width start in sorted ones."""
    out = np.empty(width + 1, dtype=np.int32)
    for start in range(0, width + 1, SOME):
        nodes = np.arange(start, min(start + SOME, width + 1))
        out[nodes] = np.searchsorted(packed, nodes << 32)
    return out


def _met(starts: np.ndarray, packed: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for each node that sorted links lead to from ``starts``, or that is one, else 0."""
    seen = np.zeros(len(ends) - 1, dtype=np.uint8)
    seen[starts] = 1
    front = starts
    while len(front):
        found = []
        for part in (front[i : i + SOME // 4] for i in range(0, len(front), SOME // 4)):
            first, n = ends[part], ends[part + 1] - ends[part]
            heads = packed[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())] & LOW
            heads = np.sort(heads[seen[heads] == 0])
            heads = heads[np.diff(heads, prepend=-1) != 0]
            seen[heads] = 1
            found.append(heads)
        front = np.concatenate(found)
    return seen


def _cycles(packed: np.ndarray, within: np.ndarray) -> int:
    """The number of strong components of several nodes of sorted links, which are marked in ``within``; a depth-first walk on arrays."""
    width = len(within)
    for _ in range(16):  # nodes without links in or out are no part of a cycle
        out, into, before = np.zeros(width, dtype=bool), np.zeros(width, dtype=bool), len(packed)
        for c in _chunks(packed):
            out[c >> 32] = True
            into[c & LOW] = True
        packed = _kept(packed, lambda c: into[c >> 32] & out[c & LOW])  # noqa: B023
        if len(packed) == before:
            break
    if not len(packed):
        return 0
    starts = _ends(packed, width)
    nodes = np.flatnonzero(np.diff(starts))
    heads, ends, at = memoryview(packed), memoryview(starts), memoryview(starts.copy())
    order, low, on = (memoryview(np.zeros(width, dtype=np.int32)) for _ in range(3))
    stack, work, count, cycles = array("i"), array("i"), 0, 0
    for root in (n for start in range(0, len(nodes), SOME) for n in nodes[start : start + SOME].tolist()):
        if order[root]:
            continue
        work.append(root)
        while work:
            node = work[-1]
            if not order[node]:
                count += 1
                order[node] = low[node] = count
                stack.append(node)
                on[node] = 1
            i, end = at[node], ends[node + 1]
            while i < end:
                follower = heads[i] & LOW
                if not order[follower]:
                    break
                if on[follower] and order[follower] < low[node]:
                    low[node] = order[follower]
                i += 1
            if i < end:
                at[node] = i + 1
                work.append(follower)
                continue
            at[node] = end
            work.pop()
            if work and low[node] < low[work[-1]]:
                low[work[-1]] = low[node]
            if low[node] == order[node]:
                several = stack[-1] != node
                cycles += several
                while True:
                    member = stack.pop()
                    on[member] = 0
                    within[member] |= several
                    if member == node:
                        break
    return cycles


def closure_weights(weight: dict, edges: list[tuple]) -> dict:
    """Σ weight over all nodes reachable from each, itself included, with one bit a component."""
    parts = strong_components([*edges, *((n, n) for n in weight)])
    home = {n: i for i, part in enumerate(parts) for n in part}
    mass = [sum(weight[n] for n in part) for part in parts]
    after = [set() for _ in parts]
    for a, b in edges:
        if home[a] != home[b]:
            after[home[a]].add(home[b])
    bits = [0] * len(parts)
    totals = [0.0] * len(parts)
    for i in range(len(parts)):  # dependencies come first
        own = 1 << i
        for j in after[i]:
            own |= bits[j]
        bits[i] = own
        total, rest = 0.0, own
        while rest:
            low = rest & -rest
            total += mass[low.bit_length() - 1]
            rest ^= low
        totals[i] = total
    return {n: totals[i] for n, i in home.items()}


def feedback(edges: list[tuple]) -> list[tuple]:
    """Back edges and self links of a depth-first walk, nodes and edges in their given order."""
    after: dict = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
        after.setdefault(b, after.default_factory())
    state: dict = {}
    out = []
    for root in list(after):
        if root in state:
            continue
        state[root] = 1
        work = [(root, iter(after[root]))]
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if state.get(nxt) == 1:
                    out.append((node, nxt))
                elif nxt not in state:
                    state[nxt] = 1
                    work.append((nxt, iter(after[nxt])))
                    break
            else:
                state[node] = 2
                work.pop()
    return list(dict.fromkeys(out))


def louvain(edges: list[tuple], resolution: float = 1.0) -> dict:
    """Community of each node; nodes move in first-seen order, ties to the lowest community."""
    names = list(dict.fromkeys(n for a, b, _ in edges for n in (a, b)))
    slot = {n: i for i, n in enumerate(names)}
    graph: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in edges:
        i, j = slot[a], slot[b]
        graph[i][j] = graph[i].get(j, 0.0) + w
        graph[j][i] = graph[j].get(i, 0.0) + w
    home = list(range(len(names)))
    while True:
        moved, own = _one_level(graph, resolution)
        ids = {c: k for k, c in enumerate(dict.fromkeys(own))}
        own = [ids[c] for c in own]
        home = [own[h] for h in home]
        if not moved or len(ids) == len(graph):
            return dict(zip(names, home, strict=True))
        merged: list[dict[int, float]] = [{} for _ in ids]
        for i, near in enumerate(graph):
            for j, w in near.items():
                a, b = own[i], own[j]
                merged[a][b] = merged[a].get(b, 0.0) + w
        graph = merged


def _one_level(graph: list[dict[int, float]], resolution: float) -> tuple[bool, list[int]]:
    degree = [sum(near.values()) for near in graph]
    total = sum(degree) or 1.0
    own, mass = list(range(len(graph))), degree[:]
    moved = False
    while True:
        changed = False
        for i, near in enumerate(graph):
            links: dict[int, float] = defaultdict(float)
            for j, w in near.items():
                if j != i:
                    links[own[j]] += w
            here = own[i]
            mass[here] -= degree[i]
            gain = lambda c: links.get(c, 0.0) - resolution * degree[i] * mass[c] / total  # noqa: B023, E731
            best, most = here, gain(here)
            for c in sorted(links):
                if gain(c) > most + 1e-12:
                    best, most = c, gain(c)
            mass[best] += degree[i]
            if best != here:
                own[i], changed, moved = best, True, True
        if not changed:
            return moved, own


def squarify(items: list[tuple[str, float]], x: float, y: float, width: float, height: float) -> list[tuple[str, float, float, float, float]]:
    """Treemap rectangles: weights descending, rows closed where the worst aspect ratio would rise."""
    rest = sorted(((k, w) for k, w in items if w > 0), key=lambda item: -item[1])
    total = sum(w for _, w in rest)
    scale = width * height / total if total else 0.0
    out = []
    i = 0
    while i < len(rest):
        side = min(width, height)
        row = [rest[i][1] * scale]
        j = i + 1
        while j < len(rest):
            longer = [*row, rest[j][1] * scale]
            if _worst(longer, side) > _worst(row, side):
                break
            row = longer
            j += 1
        thick = sum(row) / side if side else 0.0
        at = 0.0
        for (key, _), area in zip(rest[i:j], row, strict=True):
            span = area / thick if thick else 0.0
            out.append((key, x, y + at, thick, span) if width >= height else (key, x + at, y, span, thick))
            at += span
        if width >= height:
            x, width = x + thick, width - thick
        else:
            y, height = y + thick, height - thick
        i = j
    return out


def _worst(row: list[float], side: float) -> float:
    total = sum(row)
    return max(max(side * side * a / (total * total), total * total / (side * side * a)) for a in row)


def mulberry32(seed: int):
    """Seeded uniform numbers in [0, 1) with 32-bit integer steps."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return draw
