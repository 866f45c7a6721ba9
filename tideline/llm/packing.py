"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; only longer ones are cut, their first piece is the odd one. Full
pieces are sequences of their own. The others are dealt at random into shards of a bounded number of pieces.
Each shard is evolved on a few islands, a task each. An individual is a set of bins; its fitness is the number of bins, then the mean
squared fill. The first individuals put the pieces in at random order. Crossover injects whole well-filled bins of one parent into the
other, takes out the bins that hold a piece twice, with some others, and puts their other pieces in again by best fit, longest first;
in the second kind of child only full bins are injected, all short ones are opened, and what fills a bin to the last token goes
first. Each kind is made the more often, the more often it has given a new best. After an epoch the best of each island migrates to the next island of
its shard. The bins that the best individual of a shard leaves far from full are opened again, and their pieces are dealt anew
into fewer shards, until one shard is left or a turn saves next to no bin.
Every step is a table in the shared folder; nothing is gathered on the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import written
from tideline.llm.tokens import encoder

#: Pieces of a shard at most (about), islands of a shard, individuals of an island, children of an epoch, and epochs.
SHARD, ISLANDS, PEOPLE, CHILDREN, EPOCHS = 32_768, 2, 6, 20, 2
#: Times as many children in the turn that packs the last shard.
LAST = 4
#: Tokens a bin may lack and still be kept when a shard's short bins are opened again; another turn follows if one saved at least this share of the bins it opened.
LACK, WORTH = 128, 0.001
#: Share of other bins that a crossover opens.
OPENED = 0.4


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): the pieces of every document; a null text counts as empty and has the end id alone.

    Repeated rows and ids give pieces of their own, told apart by uid; a very long text is encoded whole and cut after that; extra columns
    are ignored; an empty table gives no piece.
    """

    def run(batches):
        code = encoder(path)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(code.encode(text.as_py()).astype("<u4"), np.array([end_id], "<u4"))
                raw, n = ids.tobytes(), len(ids)
                cut = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (at, to) in enumerate(zip(cut, cut[1:], strict=False)):
                    for column, x in zip(out, (i, k, at, to - at, zlib.crc32(raw[4 * at : 4 * to])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("uid", F.monotonically_increasing_id())


class Room:
    """Open bins by the room they have left, and loose pieces by length. Bins with the same room take pieces of the same length in one step, so a step is a slice of two lists."""

    def __init__(self, lengths: np.ndarray, capacity: int, assigned: np.ndarray, loads: np.ndarray, loose: np.ndarray):
        self.capacity, self.assigned, self.bins = capacity, assigned, len(loads)
        self.rooms = self._by(capacity - loads, np.arange(len(loads)))
        self.present = [r for r in range(1, capacity + 1) if self.rooms[r]]  # rooms that there are, in order
        self.stacks = self._by(lengths[loose], loose)
        self.count = np.bincount(lengths[loose], minlength=capacity + 1)

    def _by(self, key: np.ndarray, what: np.ndarray) -> list[list[int]]:
        order = np.argsort(key, kind="stable")
        ends = np.cumsum(np.bincount(key, minlength=self.capacity + 1)).tolist()
        flat = what[order].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _open(self, room: int, bins: list[int]) -> None:
        if room and bins:
            if not self.rooms[room]:
                insort(self.present, room)
            self.rooms[room] += bins

    def _take(self, room: int, k: int) -> list[int]:
        held = self.rooms[room]
        bins = held[-k:]
        del held[-k:]
        if not held:
            self.present.pop(bisect_left(self.present, room))
        return bins

    def _new(self, k: int) -> list[int]:
        self.bins += k
        return list(range(self.bins - k, self.bins))

    def _put(self, length: int, bins: list[int]) -> None:
        """One loose piece of that length into each of the bins."""
        k, stack = len(bins), self.stacks[length]
        self.assigned[stack[-k:]] = bins
        del stack[-k:]
        self.count[length] -= k

    def _exact(self, gap: int) -> tuple[tuple[int, ...], int]:
        """One or two loose lengths that fill a gap, the most even pair, so that short pieces last, and how many times there are enough of them."""
        if self.count[gap]:
            return (gap,), int(self.count[gap])
        there = self.count[1 : gap // 2 + 1] > 0
        found = np.flatnonzero(there & (self.count[gap - 1 : gap - 1 - len(there) : -1] > 0)) if len(there) else there
        for x in (found[::-1] + 1).tolist():
            if 2 * x < gap:
                return (gap - x, x), int(min(self.count[x], self.count[gap - x]))
            if self.count[x] > 1:
                return (x, x), int(self.count[x] // 2)
        return (), 0

    def place(self, order: np.ndarray, lengths: np.ndarray) -> None:
        """Puts pieces in one by one, in the given order, each by best fit."""
        for x, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
            at = bisect_left(self.present, n)
            room = self.present[at] if at < len(self.present) else self.capacity
            bins = self._take(room, 1) if at < len(self.present) else self._new(1)
            self.assigned[x] = bins[0]
            self._open(room - n, bins)

    def fill(self, exact: bool = True) -> None:
        """Puts all loose pieces in: if wanted, what fills open bins exactly goes there first; the rest, longest first, by best fit, new bins (if wanted) being filled exactly at once."""
        for room in list(self.present) if exact else ():
            while self.rooms[room]:
                found, times = self._exact(room)
                if not found:
                    break
                bins = self._take(room, min(times, len(self.rooms[room])))
                for n in found:
                    self._put(n, bins)
        for n in range(self.capacity, 0, -1):
            while self.count[n]:
                at = bisect_left(self.present, n)
                if at < len(self.present):
                    room = self.present[at]
                    bins = self._take(room, min(int(self.count[n]), len(self.rooms[room])))
                    self._put(n, bins)
                    self._open(room - n, bins)
                    continue
                left, one = self.capacity - n, self._new(1)
                self._put(n, one)
                found, times = self._exact(left) if exact and left else ((), 0)
                for m in found:
                    self._put(m, one)
                if found:
                    # the same again, as often as there are pieces for it
                    need = {m: (n, *found).count(m) for m in (n, *found)}
                    more = self._new(min(int(self.count[m]) // k for m, k in need.items()))
                    for m in (n, *found) if more else ():
                        self._put(m, more)
                    continue
                self._open(left, one)
                if n > left and self.count[n]:
                    more = self._new(int(self.count[n]) if not exact else 0)
                    if more:
                        self._put(n, more)
                        self._open(left, more)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bins by piece: best fit in falling order."""
    assigned = np.full(len(lengths), -1, np.int64)
    Room(lengths, capacity, assigned, np.empty(0, np.int64), np.arange(len(lengths))).fill(exact=False)
    return assigned


def at_random(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Bins by piece: pieces put in one by one in random order."""
    assigned = np.full(len(lengths), -1, np.int64)
    nothing = np.empty(0, np.int64)
    Room(lengths, capacity, assigned, nothing, nothing).place(rng.permutation(len(lengths)), lengths)
    return assigned


def fitness(assigned: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean squared fill."""
    loads = np.bincount(assigned, lengths)
    return -len(loads), float(np.mean((loads / capacity) ** 2))


def cross(one: np.ndarray, two: np.ndarray, lengths: np.ndarray, capacity: int, exact: bool, rng: np.random.Generator) -> np.ndarray:
    """A child: well-filled bins of two are injected into one. Bins of one that hold a piece of theirs are taken out, with others, mostly bins that aren't full; their other pieces are put in again. exact: only full bins are injected (if there are any), and all short ones opened."""
    loads1, loads2 = np.bincount(one, lengths), np.bincount(two, lengths)
    best = np.argsort(-loads2 + rng.random(len(loads2)), kind="stable")
    number = max(1, int(len(best) * rng.uniform(0.1, 0.5)))
    if exact:
        number = min(number, max(1, int((loads2 == capacity).sum())))
    take = np.zeros(len(loads2), bool)
    take[best[:number]] = True
    given = take[two]
    gone = np.zeros(len(loads1), bool)
    gone[one[given]] = True
    short = np.flatnonzero((loads1 < capacity) & ~gone)
    gone[short[rng.random(len(short)) < (1.0 if exact else rng.uniform(0.3, 1.0))]] = True
    whole = np.flatnonzero(~gone)
    gone[rng.choice(whole, int(len(whole) * OPENED), replace=False)] = True
    stay = ~given & ~gone[one]
    child = np.full(len(one), -1, np.int64)
    child[given] = (np.cumsum(take) - 1)[two[given]]
    kept = np.cumsum(~gone) - 1 + take.sum()
    child[stay] = kept[one[stay]]
    loads = np.r_[loads2[take], loads1[~gone]].astype(np.int64)
    Room(lengths, capacity, child, loads, np.flatnonzero(child < 0)).fill(exact)
    return child


def evolve(lengths: np.ndarray, capacity: int, seed: int, people: list[np.ndarray], children: int = CHILDREN, size: int = PEOPLE) -> list[np.ndarray]:
    """An epoch of an island: its people, best first. Given people live on; else all are put together at random.

    Each child is a crossover of two, and the worst of all goes. Ends early at the least number of bins that the sum of lengths allows.
    """
    rng = np.random.default_rng(seed)
    rank = lambda p: fitness(p, lengths, capacity)
    least = -(-int(lengths.sum()) // capacity)
    people = [p.copy() for p in people] or [at_random(lengths, capacity, rng) for _ in range(size)]
    people.sort(key=rank, reverse=True)
    won = [1, 3]  # new bests by kind of child
    for _ in range(children):
        if -rank(people[0])[0] <= least or len(people) < 2:
            break
        i, j = sorted(rng.choice(len(people), 2, replace=False).tolist())
        exact = bool(rng.random() * sum(won) < won[1])
        child = cross(people[j], people[i], lengths, capacity, exact, rng)
        won[exact] += rank(child) > rank(people[0])
        people = sorted([*people, child], key=rank, reverse=True)[:size]
    return people


#: A shard's state on its way between tasks: pieces, lengths and one individual's bins, as raw int64, and its place among its island's.
STATE = pa.schema([("shard", pa.int64()), ("island", pa.int64()), ("place", pa.int64()), ("uid", pa.binary()), ("length", pa.binary()), ("person", pa.binary())])
FIELDS = "shard long, island long, place long, uid binary, length binary, person binary"


def _raw(x: np.ndarray) -> bytes:
    return x.astype(np.int64).tobytes()


def _of(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", np.int64)


def _start(held: pa.Table) -> pa.Table:
    """A shard's pieces in the order of uid, so that a task done again does the same."""
    uid, length = held.column("uid").to_numpy(), held.column("length").to_numpy()
    order = np.argsort(uid, kind="stable")
    return pa.table({"shard": [held.column("shard")[0].as_py()], "island": [0], "place": [0], "uid": [_raw(uid[order])], "length": [_raw(length[order])], "person": [b""]}, schema=STATE)


def _final(held: pa.Table, capacity: int) -> pa.Table:
    """The best individual's pieces with their bins: the first piece of each is marked, and bins far from full."""
    rows = held.select(["uid", "length", "person"]).to_pylist()
    uid, length = _of(rows[0]["uid"]), _of(rows[0]["length"])
    best = max((_of(p) for p in {r["person"] for r in rows}), key=lambda p: (fitness(p, length, capacity), p.tobytes()))
    loads = np.bincount(best, length).astype(np.int64)
    name = np.full(len(loads), np.iinfo(np.int64).max)
    np.minimum.at(name, best, uid)
    order = np.lexsort((uid, best))
    ends = np.cumsum(length[order])
    offset = np.empty(len(uid), np.int64)
    offset[order] = ends - length[order] - (np.cumsum(loads) - loads)[best[order]]
    return pa.table({"uid": uid, "length": length, "sequence_id": 2 * name[best] + 1, "offset": offset, "first": offset == 0, "short": (loads + LACK < capacity)[best]})


def pack(items: DataFrame, capacity: int = 1024, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """items(uid, length, ...) with sequence_id and offset; lengths are 1 to capacity, and uid tells the rows apart.

    Other columns are kept as they are (none may be called sequence_id or offset). Pieces of equal length are taken in an order that rests on uid, so
    the same items give the same result. An empty table gives an empty one.
    """
    items = written(items, "pieces")
    full = items.where(F.col("length") >= capacity).select("uid", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = [full]
    rest = items.where(F.col("length") < capacity).select("uid", "length")
    count, opened, turn = rest.count(), None, 0

    def epoch(salt: int, children: int):
        def run(held: pa.Table) -> pa.Table:
            rows = held.select(["shard", "island", "uid", "length", "person"]).to_pylist()
            head = rows[0]
            people = [_of(p) for p in sorted({r["person"] for r in rows if r["person"]})]
            people = evolve(_of(head["length"]), capacity, (head["shard"] * 131 + head["island"]) * 17 + salt, people, children)
            n = len(people)
            return pa.table({"shard": [head["shard"]] * n, "island": [head["island"]] * n, "place": list(range(n)), "uid": [head["uid"]] * n, "length": [head["length"]] * n, "person": [_raw(p) for p in people]}, schema=STATE)

        return run

    while count:
        shards = -(-count // shard)
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(shards)))
        state = dealt.groupBy("shard").applyInArrow(_start, FIELDS)
        state = state.withColumn("island", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))))
        for e in range(epochs):
            step = epoch(e * 7 + turn, CHILDREN * (LAST if shards == 1 else 1))
            state = written(state.groupBy("shard", "island").applyInArrow(step, FIELDS), "people")
            if e < epochs - 1:
                # the best of an island also goes to the next island of its shard
                best = state.groupBy("shard", "island").agg(F.min_by(F.struct("place", "uid", "length", "person"), "place").alias("x"))
                state = state.unionByName(best.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "x.*"))
        fields = "uid long, length long, sequence_id long, offset long, first boolean, short boolean"
        packed = written(state.groupBy("shard").applyInArrow(lambda held: _final(held, capacity), fields), "packed")
        n = packed.agg(F.count_if("first").alias("bins"), F.count_if(F.expr("first and short")).alias("short"), F.count_if("short").alias("rest")).first()
        last = shards == 1 or opened is not None and opened - n["bins"] < WORTH * opened
        done.append((packed if last else packed.where("not short")).select("uid", "sequence_id", "offset"))
        rest = packed.where("short").select("uid", "length")
        count, opened, turn = (0 if last else n["rest"]), n["short"], turn + 1
    where = done[0]
    for d in done[1:]:
        where = where.union(d)
    where = where.select(F.col("uid").alias("key"), "sequence_id", "offset")
    return items.join(where, items["uid"] == where["key"]).drop("key")
