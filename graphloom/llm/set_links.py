"""From an index of lists to the components of linked sets, without the pairs of any list.

Sets link where 100 * |x & y| >= percent * |x | y|. An index puts each set on lists such that linked sets
share one; what follows is the same for every index and exact:

* Equal sets are one set from the start. The leader of a list is its smallest set. It is compared with
  the others: first each set with the leader that it meets on most lists, then with those of other
  leaders that are not connected to it by then. An answer holds what the set lacks and has beside its leader.
* Lists of one leader whose other sets are still in several parts are open. On small ones (``CROWD``) pairs from
  different parts are looked at, sizes and sketches first, and their intersections are derived from the
  answers of a shared leader: ``|x & y| = |L| - |(L-x) | (L-y)| + |(x-L) & (y-L)|``.
* On crowded open lists no pairs are made. Their sets, each once whatever its lists, go on to lists of single
  members. With one order of members for all, a set of n shares with a linked one at least one of its first
  ``b(n) = n - ceil(percent * n / 100) + 1`` members, and ``1 + e`` of its first ``b(n) + e``. Those are taken
  with ``e(n) = min(b(n), n - b(n))``; as ``e`` grows with n and a partner has at least ``percent * n / 100``
  members, both may then leave the ``e`` of the least partner of them out again, those that most sets have.
  The order puts members behind that a bounded sample of sets has often, so a passage that many have in common
  is not taken at all; a wrong guess costs time and no link. After ``ROUNDS`` such rounds lists left are treated like small ones.

A set's 64-bit id is checked against a second print of it; were two sets to share an id, other ids are
drawn. Members are 64-bit prints of shingles.

Intermediate tables are written to the shared checkpoint folder. Texts of sets on any list are read again
by a print of the text, which is broadcast while there are at most ``SHIPPED`` (8 bytes each) and joined
by a shuffle beyond that.

Defined results: null and empty texts and texts without words have the empty set, are linked with
nothing and are their own component; texts of fewer than ``k`` words have one shingle, the whole
sequence; repeated rows have equal sets; a null id never names a component unless all its members'
ids are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored, texts_of, word_prints

#: Makes the sorted distinct prints of each of a batch's texts.
Maker = Callable[[list[bytes]], list[np.ndarray]]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts that a task hashes at once.
CHUNK = 200
#: Sets of a leader's lists in several parts from which on those are crowded.
CROWD = 32
#: Times that crowded lists are dealt anew; what is crowded then is a family whose sets are all about as far
#: apart as the threshold, which no shared passage explains, and its pairs are looked at, once a leader.
ROUNDS = 1
#: List entries for each file (and task) of a round's tables.
FILE_ROWS = 50_000
#: Tasks that the pairs of a large family are dealt to.
SHARES = 16
#: Links that one task connects at once (some tens of bytes each).
TASK_LINKS = 500_000
#: Members of the sets (a sample by id) that tell which members are frequent; of those at most half are sent to the tasks.
SAMPLE = 2_000_000
#: Prints of texts that are broadcast as a filter (8 bytes each); beyond that they are joined.
SHIPPED = 500_000


@dataclass(frozen=True)
class Index:
    """Lists of a set, its sketch, and whether two sketches and sizes allow a link (columns ``x.size``, ``x.sketch``)."""

    keys: Callable[[np.ndarray], np.ndarray]
    sketch: Callable[[np.ndarray], np.ndarray]
    near: Callable[[str, str], Column]


def shingles(k: int) -> Maker:
    """Distinct shingles of ``k`` words, A-Z lower-cased."""

    def make(texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), CHUNK):
            part = texts[i : i + CHUNK]
            flat = _LOWER[np.frombuffer(b"\n".join(part) + b"\n", np.uint8)]
            starts, prints = word_prints(flat)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            cuts = np.searchsorted(starts, ends)
            run = np.zeros(max(len(prints) - k + 1, 0), np.uint64)
            for j in range(k):
                run = mix64(run + prints[j : j + len(run)] + np.uint64(j + 1))
            low = 0
            for high in cuts.tolist():
                n = high - low
                if n >= k:
                    out.append(np.unique(run[low : high - k + 1]))
                elif n:
                    value = np.full(1, n, np.uint64)
                    for p in prints[low:high]:
                        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + p)
                    out.append(value)
                else:
                    out.append(np.zeros(0, np.uint64))
                low = high
        return out

    return make


def set_id(members: np.ndarray, seed: int = 0) -> int:
    """A 64-bit print of a whole set; another one for each seed."""
    salt = np.uint64((0x5851F42D4C957F2D + seed * 0x9E3779B97F4A7C15) % (1 << 64))
    value = np.full(1, len(members), np.uint64) + np.add.reduce(mix64(members ^ salt), keepdims=True)
    return int(mix64(value).view(np.int64)[0])


def _lists(offsets: list[int], parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            yield batch.slice(i, CHUNK)


def described(source: DataFrame, make: Maker, seed: int) -> DataFrame:
    """(id, n, sid, second, print): each row's set under two prints, and the print of its text."""
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            sets = make(texts_of(part.column("text")))
            columns = ([len(s) for s in sets], [set_id(s, seed) for s in sets], [set_id(s, seed + 1) for s in sets])
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, pa.int64()) for c in columns], part.column("print")], names=["id", "n", "sid", "second", "print"])

    return source.select("id", "text", "print").mapInArrow(run, f"id {kind}, n long, sid long, second long, print long")


def identified(source: DataFrame, make: Maker) -> tuple[DataFrame, int]:
    """The described rows under ids that tell all their sets apart, and the seed of those."""
    for seed in range(0, 16, 2):
        rows = stored(described(source, make, seed))
        if rows.groupBy("sid").agg(F.min("second").alias("low"), F.max("second").alias("high")).filter("low <> high").isEmpty():
            return rows, seed
    raise RuntimeError("no seed tells all sets apart")


def index_entries(source: DataFrame, make: Maker, index: Index, seed: int) -> DataFrame:
    """(key, size, sid): the lists of each set, once for each set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _chunks(batches):
            sids, sizes, keys = [], [], [np.zeros(0, np.uint64)]
            for members in make(texts_of(part.column("text"))):
                sid = set_id(members, seed)
                if sid not in seen and len(members):
                    seen.add(sid)
                    sids.append(sid)
                    sizes.append(len(members))
                    keys.append(index.keys(members))
            times = [len(k) for k in keys[1:]]
            own = [np.repeat(np.array(v, t), times) for v, t in ((sizes, np.int32), (sids, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *map(pa.array, own)], names=["key", "size", "sid"])

    return source.select("text").mapInArrow(run, "key long, size int, sid long")


def listed_sets(source: DataFrame, make: Maker, index: Index, rows: DataFrame, lists: DataFrame, seed: int) -> DataFrame:
    """(sid, size, sketch, members) of the sets on any list, from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            sets = make(texts_of(part.column("text")))
            sketches = [index.sketch(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            widths = [np.concatenate([[0], np.cumsum([len(v) for v in own])]).tolist() for own in (sketches, sets)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s, seed) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), _lists(widths[0], sketches), _lists(widths[1], sets)], names=["sid", "size", "sketch", "members"])

    wanted = rows.filter("n > 0").groupBy("sid").agg(F.min("print").alias("print")).join(lists.select("sid").distinct(), "sid", "left_semi").select("print")
    wanted = stored(wanted)
    few = wanted.limit(SHIPPED + 1).count() <= SHIPPED
    texts = source.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "print", "left_semi").select("text").distinct()
    return stored(texts.mapInArrow(run, "sid long, size int, sketch array<long>, members array<long>"))


def before(n: Column, percent: int) -> tuple[Column, Column]:
    """How many members of a set of ``n`` are taken, and how many of those it may leave out again."""

    def parts(size: Column) -> tuple[Column, Column]:
        least = F.ceil(size * percent / 100)
        first = size - least + 1
        return first, F.least(first, least - 1)

    first, more = parts(n)
    return first + more, parts(F.ceil(n * percent / 100))[1]


def rare_members(sets: DataFrame, known: np.ndarray, times: np.ndarray) -> DataFrame:
    """(member, sid, size): the first ``taken`` members of each set, those that the sample has most often last.

    ``known`` is sorted and has members of the sample, ``times`` how many of its sets have them.
    """
    sent = sets.sparkSession.sparkContext.broadcast((np.append(known, np.iinfo(np.int64).max), np.append(times, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = sent.value
        for part in _chunks(batches):
            members = part.column("members").flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(names, members)
            seen = np.where(names[at] == members, counts[at], 0)
            ends = np.cumsum(part.column("size").to_numpy())
            taken = part.column("taken").to_numpy()
            picked = [np.zeros(0, np.int64)]
            for low, high, n in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), taken.tolist(), strict=True):
                picked.append(low + np.argsort(seen[low:high], kind="stable")[:n])
            own = [pa.array(np.repeat(part.column(c).to_numpy(), taken)) for c in ("sid", "size")]
            yield pa.RecordBatch.from_arrays([pa.array(members[np.concatenate(picked)]), *own], names=["member", "sid", "size"])

    return sets.select("sid", "size", "taken", "members").mapInArrow(run, "member long, sid long, size int")


def _least_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of a task's links with the least node that it is connected to by them."""
    parent: dict[int, int] = {}

    def root(n: int) -> int:
        while (up := parent.setdefault(n, n)) != n:
            parent[n] = parent[up]
            n = up
        return n

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(n) for n in part], pa.int64())], names=["u", "v"])


def connected(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(node, component): the least node of each node's component.

    Tasks of at most ``TASK_LINKS`` links first connect what they hold, which is all of it where there are no
    more links than that; else rounds of contraction to least neighbours follow.
    """
    edges = keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    n = edges.count()
    tasks = -(-n // TASK_LINKS)
    local = (edges.coalesce(1) if tasks <= 1 else edges.repartition(tasks)).mapInArrow(_least_nodes, "u long, v long")
    if tasks <= 1:
        return keep(local).toDF("node", "component")
    edges = keep(local.filter("u <> v").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        parent = keep(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("component")))
        steps.append(parent)
        left = edges.join(parent.select(F.col("node").alias("u"), F.col("component").alias("a")), "u").join(parent.select(F.col("node").alias("v"), F.col("component").alias("b")), "v")
        edges = keep(left.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    result = steps[0]
    for parent in steps[1:]:
        step = parent.select(F.col("node").alias("component"), F.col("component").alias("to"))
        result = result.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return keep(result) if len(steps) > 1 else result


class Resolver:
    """Compares sets along lists; links that it finds make up ``parts`` (node, component)."""

    def __init__(self, sets: DataFrame, index: Index, percent: int, entries: int) -> None:
        """``entries``: rows of the first lists; tables of a round have a file for each ``FILE_ROWS`` of them, not one a shuffle partition."""
        self.sets, self.index, self.percent = sets, index, percent
        self.files = 6 + entries // FILE_ROWS
        self.answers: DataFrame | None = None
        self.parts: DataFrame | None = None

    def keep(self, df: DataFrame) -> DataFrame:
        return stored(df.coalesce(self.files))

    def parted(self, rows: DataFrame, sid: str = "sid", part: str = "part") -> DataFrame:
        """``rows`` with the part of ``sid``."""
        if self.parts is None:
            return rows.withColumn(part, F.col(sid))
        own = self.parts.select(F.col("node").alias(sid), F.col("component").alias("__part"))
        return rows.join(own, sid, "left").withColumn(part, F.coalesce("__part", sid)).drop("__part")

    def link(self, found: DataFrame) -> None:
        if self.parts is None:
            self.parts = connected(found, self.keep)
            return
        # What is connected already stays so: only parts are joined further.
        ends = self.parted(self.parted(found, "a", "u"), "b", "v").select(F.col("u").alias("a"), F.col("v").alias("b"))
        more = connected(ends, self.keep)
        step = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
        kept = self.parts.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        fresh = more.join(self.parts.select("node"), "node", "left_anti").select("node", "component")
        self.parts = self.keep(kept.unionByName(fresh))

    def members(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        """The pairs with their sets ``x`` and ``y``."""
        own = lambda s, name: self.picked(pairs.select(F.col(s).alias("sid"))).select(F.col("sid").alias(s), F.col("members").alias(name))
        return pairs.join(own(a, "x"), a).join(own(b, "y"), b)

    def picked(self, sids: DataFrame) -> DataFrame:
        """The sets of these ids; where they are few, others are not even read into a shuffle."""
        wanted = self.keep(sids.distinct())
        few = wanted.limit(SHIPPED + 1).count() <= SHIPPED
        return self.sets.join(F.broadcast(wanted) if few else wanted, "sid", "left_semi")

    def answer(self, pairs: DataFrame) -> None:
        """Compares (leader, sid) pairs: what each has alone is kept, and links follow."""
        met = self.members(self.keep(pairs.select("leader", "sid")), "sid", "leader")
        found = self.keep(met.select("leader", "sid", F.size("y").alias("n_l"), F.size("x").alias("n"), F.array_except("y", "x").alias("gone"), F.array_except("x", "y").alias("extra")))
        self.answers = found if self.answers is None else self.answers.unionByName(found)
        self.link(found.filter(self.links_at(F.col("n") - F.size("extra"), F.col("n_l"), F.col("n"))).select(F.col("leader").alias("a"), F.col("sid").alias("b")))

    def links_at(self, shared: Column, n: Column, m: Column) -> Column:
        return shared * (100 + self.percent) >= self.percent * (n.cast("long") + m)

    def lead(self, lists: DataFrame) -> DataFrame:
        """(key, size, sid, leader) of the lists (key, size, sid, rank) with sets in several parts; the least rank leads."""
        named = self.parted(lists)
        heads = named.groupBy("key").agg(F.min(F.struct("rank", "size", "sid")).alias("head"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
        return self.keep(named.select("key", "size", "sid").join(heads.select("key", F.col("head.sid").alias("leader")), "key").distinct())

    def compare_leaders(self, lists: DataFrame) -> None:
        """Each set with its leaders, where sizes and sketches allow a link.

        Sets of large families meet many leaders: then first the one on most lists, and of the others
        those that this has not connected.
        """
        pairs = lists.filter("sid <> leader").groupBy("leader", "sid").agg(F.count(F.lit(1)).alias("met"))
        if self.answers is not None:
            pairs = pairs.join(self.answers.select("leader", "sid"), ["leader", "sid"], "left_anti")
        facts = self.sets.select("sid", "size", "sketch")
        close = pairs.alias("p").join(facts.alias("x"), F.col("p.sid") == F.col("x.sid")).join(facts.alias("l"), F.col("p.leader") == F.col("l.sid")).filter(self.index.near("x", "l"))
        close = self.keep(close.select("p.leader", "p.sid", "p.met"))
        n = close.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("sid").alias("sets")).first()
        if n["pairs"] <= 2 * n["sets"]:
            self.answer(close)
            return
        first = self.keep(close.groupBy("sid").agg(F.max_by("leader", F.struct("met", "leader")).alias("leader")))
        self.answer(first)
        others = self.parted(self.parted(close.join(first, ["leader", "sid"], "left_anti"), "leader", "u"), "sid", "v")
        self.answer(others.filter("u <> v"))

    def compare_pairs(self, lists: DataFrame) -> None:
        """Pairs of different parts among the sets (size, sid, part) of each leader, which has ``met`` of them."""
        known = lists.join(self.sets.select("sid", "sketch"), "sid")
        known = known.join(self.answers.select("leader", "sid", (F.size("gone") + F.size("extra")).alias("apart")), ["leader", "sid"], "left")
        # Large families are dealt to several tasks: each of their sets meets all others, those in one share.
        shares = F.when(F.col("met") > CROWD, SHARES).otherwise(1)
        x = known.withColumn("share", F.pmod(F.xxhash64("sid"), shares).cast("int")).alias("x")
        y = known.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).alias("y")
        bound = F.coalesce(F.abs(F.col("x.apart") - F.col("y.apart")) * (100 + self.percent) <= (100 - self.percent) * (F.col("x.size") + F.col("y.size")), F.lit(True))
        pending = x.join(y, (F.col("x.leader") == F.col("y.leader")) & (F.col("x.share") == F.col("y.share")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.part") != F.col("y.part")) & bound & self.index.near("x", "y"))
        leader = F.when(F.col("x.apart").isNotNull() & F.col("y.apart").isNotNull(), F.col("x.leader"))
        pending = stored(pending.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), leader.alias("leader")).groupBy("a", "b").agg(F.min("leader").alias("leader")))
        if pending.isEmpty():
            return
        side = lambda s: self.answers.select("leader", F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), "n_l", F.col("gone").alias(f"gone_{s}"), F.col("extra").alias(f"extra_{s}"))
        derived = pending.filter("leader is not null").join(side("a"), ["leader", "a"]).join(side("b").drop("n_l"), ["leader", "b"])
        shared = F.col("n_l") - F.size(F.array_union("gone_a", "gone_b")) + F.size(F.array_intersect("extra_a", "extra_b"))
        late = derived.filter(self.links_at(shared, F.col("n_a"), F.col("n_b"))).select("a", "b")
        rest = pending.filter("leader is null").select("a", "b")
        plain = self.members(rest, "a", "b").filter(self.links_at(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")
        self.link(self.keep(late.unionByName(plain)))

    def dealt_anew(self, crowded: DataFrame) -> DataFrame:
        """(key, size, sid, rank): the sets of crowded lists on lists of single members, rare ones first.

        The rank is the number of members taken that no other set has there: of a family, what lies in its middle leads.
        """
        sets = self.picked(crowded.select("sid"))
        step = -(-sets.agg(F.sum("size")).first()[0] // SAMPLE)
        sampled = sets.filter(F.pmod(F.xxhash64("sid"), F.lit(step)) == 0).select(F.explode("members").alias("member"))
        known = sampled.groupBy("member").agg(F.count(F.lit(1)).cast("int").alias("times")).filter("times > 1").orderBy("member").toArrow()
        taken, spare = before(F.col("size"), self.percent)
        # Dealt once by member: counting and picking read the same exchange. Members that one set has alone make no list.
        rare = rare_members(sets.withColumn("taken", taken.cast("int")), *(known.column(c).to_numpy() for c in ("member", "times"))).repartition("member")
        shared = rare.groupBy("member").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
        order = rare.join(shared, "member").groupBy("sid", "size").agg(F.array_sort(F.collect_list(F.struct("times", "member"))).alias("shared"))
        kept = order.withColumn("kept", F.size("shared") - spare.cast("int")).filter("kept > 0").withColumn("rank", taken - F.size("shared"))
        return kept.select(F.explode(F.slice("shared.member", F.lit(1), F.col("kept"))).alias("key"), "size", "sid", "rank")

    def run(self, lists: DataFrame) -> DataFrame | None:
        """The parts once every list (key, size, sid, leader) is settled."""
        for round_ in range(ROUNDS + 1):
            self.compare_leaders(lists)
            # Leaders have been compared with all of their lists, which from here on are one list.
            rest = self.parted(lists.filter("sid <> leader").select("leader", "sid", "size").distinct())
            open_ = rest.groupBy("leader").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("met")).filter("low <> high")
            rest = self.keep(rest.join(open_.select("leader", "met"), "leader"))
            if round_ == ROUNDS:
                self.compare_pairs(rest)
                break
            self.compare_pairs(rest.filter(F.col("met") <= CROWD))
            crowded = rest.filter(F.col("met") > CROWD)
            if crowded.isEmpty():
                break
            lists = self.lead(self.dealt_anew(crowded))
            if lists.isEmpty():
                break
        return self.parts


def components(docs: DataFrame, make: Maker, index: Index, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, component) of every row: set size and the least id reachable by links."""
    source = docs.select(docs[doc_id].alias("id"), docs[text].cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    rows, seed = identified(source, make)
    # Dealt once by list: finding the lists of several sets and picking their entries read the same exchange.
    entries = index_entries(source, make, index, seed).repartition("key")
    several = entries.groupBy("key").agg(F.min(F.struct("size", "sid")).alias("head"), F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low <> high")
    lists = stored(entries.join(several.select("key", F.col("head.sid").alias("leader")), "key").distinct())
    parts = Resolver(listed_sets(source, make, index, rows, lists, seed), index, percent, lists.count()).run(lists)

    least = rows.filter("n > 0").groupBy("sid").agg(F.min("id").alias("low"))
    if parts is not None:
        least = least.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("part", F.coalesce("component", "sid")).drop("component")
        least = least.join(least.groupBy("part").agg(F.min("low").alias("component")), "part")
    named = least.select("sid", F.col("component" if parts is not None else "low").alias("component"))
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(named, "sid", "left")
    return out.select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
