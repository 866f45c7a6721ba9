"""SimHash near-dedup by a Gray-order hierarchical index.

Fingerprints that differ in at most k of 64 bits agree on at least one of k+1 blocks of bits, and on at least m-k of m blocks. So each distinct
fingerprint goes to a bucket for each choice of m-k blocks, by their bits; m grows with the number of fingerprints, so that buckets stay small. In a task the fingerprints of its buckets are sorted by
bucket and Gray rank, so that neighbours share many bits. A hierarchy stands over them: a node knows the bits all
fingerprints below share (mask and pattern). Two nodes are compared by the shared bits in which they differ: more
than k, and all pairs below are cut off at once; if no two members can differ in more than k, they are linked at
once. Nodes that are known to be of one component already are passed over, so a dense group of n isn't n squared.

Fingerprints may also be wider, for similarities that 64 bits are too few to tell; then buckets are bands of bits, and the pairs found
are only candidates, whose shingles are compared.

A bucket above TILE members is dealt into tiles by a hash, and each pair of its tiles is a task of its own: no task
holds more, and no link is lost. Tasks emit a tree for each component they see, not its links.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import components, local_labels, star_edges, tree_edges
from tideline.llm.shared import BROADCAST_ROWS, fresh_key, without, written

#: Fingerprints of one bucket that a task takes; larger buckets are dealt into tiles.
TILE = 4096
#: Words of 64 bits of the node pairs compared at once in a task: bounds its memory.
FRONTIER = 1 << 18
#: Pairs whose shingles are compared before those that they join are passed over.
CHECKED = 256


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """SimHash of the word n-grams, repeats included: A-Z lower-cased, words parted by ASCII white space, XXH64 with a seed; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        total += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long): each row's fingerprint, its 64 bits as a signed long. Null texts count as empty."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the sequence of Gray codes."""
    out = x.copy()
    for by in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(by)
    return out


def ones(x: np.ndarray) -> np.ndarray:
    """Set bits of each fingerprint, of one word or of a row of words."""
    return np.bitwise_count(x) if x.ndim == 1 else np.bitwise_count(x).sum(1, dtype=np.int32)


class GrayIndex:
    """The hierarchy over fingerprints (of one word of 64 bits, or rows of words) with bucket keys; keys of different buckets are never compared."""

    def __init__(self, fp: np.ndarray, key: np.ndarray):
        ranks = [gray_rank(fp)] if fp.ndim == 1 else [gray_rank(fp[:, i]) for i in range(min(2, fp.shape[1]) - 1, -1, -1)]
        self.order = np.lexsort((*ranks, key))
        self.frontier = max(16, FRONTIER // (1 if fp.ndim == 1 else fp.shape[1]))
        fp, key = fp[self.order], key[self.order]
        # by level, from single fingerprints up: bits set in all, in any; smallest and largest key
        self.levels = [(fp, fp, key, key)]
        while len(self.levels[-1][0]) > 1:
            every, some, low, high = self.levels[-1]
            at = np.arange(0, len(every), 2)
            self.levels.append((np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at), low[at], np.maximum.reduceat(high, at)))

    def labels(self, k: int, check=None, known: np.ndarray | None = None) -> np.ndarray:
        """Component labels, by place in order, of the links of at most k differing bits, and (if given) for which check(a, b) of their places holds.

        What is equal in known (by place in order) is of one component already.
        """
        n = len(self.levels[0][0])
        self.check = check
        self.label = np.arange(n)
        if known is not None and n:
            _, first, group = np.unique(known, return_index=True, return_inverse=True)
            self.label = first[group]
        if n > 1:
            self._known()
            self._join(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), k)
        return self.label

    def _known(self) -> None:
        """For each node the component of all its members, or -1."""
        self.whole = [self.label]
        while len(self.whole[-1]) > 1:
            x = self.whole[-1]
            if len(x) % 2:
                x = np.append(x, x[-1])
            self.whole.append(np.where(x[::2] == x[1::2], x[::2], -1))

    def _link(self, left: np.ndarray, right: np.ndarray) -> None:
        self.label = local_labels(len(self.label), left, right, self.label)

    def _checked(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links the pairs that check() takes, neighbours first; what is of one component by then isn't checked."""
        order = np.argsort(b - a, kind="stable")
        for at in range(0, len(order), CHECKED):
            x, y = a[order[at : at + CHECKED]], b[order[at : at + CHECKED]]
            apart = self.label[x] != self.label[y]
            x, y = x[apart], y[apart]
            if len(x):
                good = self.check(x, y)
                self._link(x[good], y[good])

    def _near(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Places of the pairs of single fingerprints that differ in at most k bits; of wide ones the first half decides about most."""
        fp = self.levels[0][0]
        if fp.ndim == 1:
            return np.flatnonzero(np.bitwise_count(fp[a] ^ fp[b]) <= k)
        half = fp.shape[1] // 2
        first = ones(fp[a, :half] ^ fp[b, :half]) if half else np.zeros(len(a), np.int32)
        left = np.flatnonzero(first <= k)
        return left[first[left] + ones(fp[a[left], half:] ^ fp[b[left], half:]) <= k]

    def _join(self, level: int, a: np.ndarray, b: np.ndarray, k: int) -> None:
        """Links the members of node pairs (a <= b) of a level."""
        while True:
            every, some, low, high = self.levels[level]
            keep = low[b] <= high[a]
            whole = self.whole[level]
            keep &= (whole[a] < 0) | (whole[a] != whole[b])
            a, b = a[keep], b[keep]
            if level == 0:
                near = self._near(a, b, k)
                (self._link if self.check is None else self._checked)(a[near], b[near])
                return
            differ = every[a] ^ every[b]
            shared = ~(every[a] ^ some[a]) & ~(every[b] ^ some[b])
            keep = ones(differ & shared) <= k
            a, b, differ, shared = a[keep], b[keep], differ[keep], shared[keep]
            close = np.zeros(len(a), bool) if self.check else (ones(~shared | differ) <= k) & (low[a] == high[b])
            if close.any():
                size = 1 << level
                n = len(self.label)
                for x in (a[close], b[close]):
                    first = np.minimum(a[close] * size, n - 1)
                    members = (x[:, None] * size + np.arange(size)).ravel()
                    firsts = np.repeat(first, size)
                    inside = members < n
                    self._link(firsts[inside], members[inside])
                a, b = a[~close], b[~close]
            if not len(a):
                return
            one = a == b
            x = np.concatenate([2 * a, 2 * a, 2 * a + 1, (2 * a + 1)[~one]])
            y = np.concatenate([2 * b, 2 * b + 1, 2 * b + 1, (2 * b)[~one]])
            level -= 1
            if level == 0:
                inside = (y < len(self.label)) & (x < y)
            else:
                inside = y < len(self.levels[level][0])
            a, b = x[inside], y[inside]
            if len(a) > self.frontier:
                order = np.argsort(b - a, kind="stable")  # neighbours first: what they link is passed over later
                for at in range(0, len(order), self.frontier):
                    part = order[at : at + self.frontier]
                    self._join(level, a[part], b[part], k)
                    self._known()
                return


def masks(bits: int, parts: int) -> list[int]:
    """Masks of 64 bits cut into ``parts`` blocks: of every choice of parts - bits blocks, as fingerprints that differ in at most ``bits`` bits agree on one such choice."""
    base, more = divmod(64, parts)
    widths = [base + (i < more) for i in range(parts)]
    block = [((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(parts), parts - bits)]


def scheme(count: int, bits: int, tile: int = TILE) -> list[int]:
    """The fewest masks whose buckets hold a fraction of a tile's unlike fingerprints on average: more blocks give more and narrower buckets."""
    for parts in range(bits + 1, bits + 5):
        found = masks(bits, parts)
        if count >> min(m.bit_count() for m in found) <= tile // 8:
            break
    return found


def links(distinct: DataFrame, bits: int = 4, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """(u, v): edges between fingerprints (column fp) whose components are those of all links of at most ``bits`` differing bits."""
    count = distinct.count()
    found = masks(bits, parts) if parts else scheme(count, bits, tile)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(signed(m))), F.lit(i)) for i, m in enumerate(found)])
    routed = distinct.select(F.col("fp").alias("node"), F.explode(keys).alias("bucket"))
    return tree_links(routed, lambda held: held.column("node").to_numpy().view(np.uint64), bits, count * len(found), tile)


def tree_links(routed: DataFrame, codes, bits: int, total: int, tile: int = TILE, check=None, star: bool = False) -> DataFrame:
    """(u, v): trees (star: stars) that join the nodes of routed(node, bucket, ...) which links of at most ``bits`` differing bits join within buckets.

    With a column ``label``, rows of one label count as linked, and u and v are labels. codes(table) gives the fingerprints of a task's rows; check(table, order), if given, what GrayIndex.labels() asks of a pair. Rows weigh 1 or
    what their column ``weight`` says, ``total`` in all. Buckets heavier than a tile are dealt into tiles, and each pair of tiles is a task.
    """
    weight = F.col("weight") if "weight" in routed.columns else F.lit(1)
    # at most total / tile buckets are so heavy; others are dealt by their key
    large = routed.groupBy("bucket").agg(F.sum(weight).alias("w")).where(F.col("w") > tile).select(fresh_key("bucket").alias("large"), (F.ceil(F.col("w") / tile) + 1).cast("int").alias("g"))
    large = written(large, "large")
    spread = routed.drop("weight").join(large, F.col("bucket") == F.col("large"), "left").drop("large")
    spread = spread.withColumn("mine", F.expr("cast(pmod(xxhash64(node), g) as int)"))
    other = F.when(F.col("g").isNull(), F.array(F.lit(-1))).otherwise(F.expr("filter(sequence(0, g - 1), j -> j <> mine)"))
    tasks = spread.withColumn("other", F.explode(other))
    # light buckets share tasks of a few tiles' rows
    shares = max(1, -(-total // (4 * tile)))
    task = F.when(F.col("g").isNull(), F.expr(f"pmod(xxhash64(bucket), {shares})")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))

    def run(held: pa.Table) -> pa.Table:
        index = GrayIndex(codes(held), held.column("bucket").to_numpy())
        named = "label" in held.column_names
        node = held.column("label" if named else "node").to_numpy()[index.order]
        label = index.labels(bits, check and check(held, index.order), node if named else None)
        u, v = star_edges(label, node) if star else (node[x] for x in tree_edges(label))
        if named:  # many rows of a label name the same link
            u, v = np.unique(np.stack([u, v]), axis=1)
        return pa.table({"u": u, "v": v}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return tasks.withColumn("task", task).drop("g", "mine", "other").groupBy("task").applyInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, bits: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(id, fp, component_id) per row: component_id is the smallest id reachable over fingerprints that differ in at most ``bits`` bits.

    Rows with a null id have a fingerprint and component like others but never name one (a component of such rows only:
    null). Repeated rows come out as often as they come in; an empty table gives an empty one.
    """
    marked = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    label = components(links(distinct, bits, tile)).withColumnRenamed("node", "fp")
    member = written(distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "members")
    named = written(member.groupBy("label").agg(F.min("least").alias("component_id")), "named").select(fresh_key("label").alias("key"), "component_id")
    of = written(member.join(named, member["label"] == named["key"]).select("fp", "component_id"), "of").select(fresh_key("fp").alias("key"), "component_id")
    return marked.join(of, marked["fp"] == of["key"]).select(id_col, "fp", "component_id")


#: Words of a wide fingerprint, and the share of links at the threshold that its bands must find.
WIDE, RECALL = 4, 0.99
#: Deviations above the mean of differing bits at the threshold up to which pairs are candidates. Sets of few shingles differ more than the angle says (four of five: 48 bits, not 39).
DEVIATIONS = 5
#: Bands whose links are joined before the others are looked at.
FIRST = 3
#: Unlike texts that a band's bucket holds on average, as a power of two.
BUCKET = 6
#: Bytes of shingles of one group that a task holds; larger groups are dealt into tiles.
SETS_TILE = 1 << 23
#: A bit's value by byte value and place, to count bits from counts of bytes.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: str | None, n: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct word n-grams, sorted (fewer words: the whole sequence; none: no hash)."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(split), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    m = max(1, len(split) - n + 1)
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts[:m].tolist(), ends[min(n, len(split)) - 1 :].tolist(), strict=True)], np.uint64))


def wide_fingerprint(text: str | None, n: int = 5, seed: int = 42, words: int = WIDE) -> np.ndarray:
    """SimHash of ``words`` times 64 bits over the shingles() (none: zero)."""
    h = shingles(text, n, seed)
    if not len(h):
        return np.zeros(words, np.uint64)
    total = np.zeros((words * 8, 8), np.int64)
    # each word's hash of a shingle is a mix of the one hash with a constant of its own
    odd = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & (1 << 64) - 1 for i in range(words)], np.uint64)
    for at in range(0, len(h), 1 << 13):
        x = h[at : at + (1 << 13), None] * odd
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        places = x.view(np.uint8).reshape(-1, words * 8).astype(np.int64) + np.arange(words * 8) * 256
        total += np.bincount(places.ravel(), minlength=words * 8 * 256).reshape(-1, 256) @ BYTE_BITS
    return np.packbits((total * 2 > len(h)).ravel(), bitorder="little").view("<u8")


def wide_bits(similarity: float, words: int = WIDE) -> int:
    """Differing bits up to which two texts are candidates: what the angle of that Jaccard similarity gives on average, and DEVIATIONS."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(64 * words * p + DEVIATIONS * (64 * words * p * (1 - p)) ** 0.5)


def bands(count: int, similarity: float, words: int = WIDE) -> np.ndarray:
    """Places of bits, a row a band: wide enough that a band's bucket holds about 2 ** BUCKET unlike texts, and so many that pairs at the threshold miss all with a chance of 1 - RECALL, over all numbers of bits in which they may differ."""
    p, size = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi), 64 * words
    width = int(np.clip(np.ceil(np.log2(max(2, count))) - BUCKET, 8, 40))
    chance = np.array([math.comb(size, d) * p**d * (1 - p) ** (size - d) for d in range(size // 2)])
    alike = np.array([math.comb(size - d, width) / math.comb(size, width) for d in range(size // 2)])
    number = 1
    while chance @ (1 - alike) ** number > 1 - RECALL:
        number += 1
    rng = np.random.default_rng(7)
    return np.array([rng.choice(size, width, replace=False) for _ in range(number)])


#: What names a text: whether its id is null, its id, and two hashes of the text. The smallest name of a group is its representative's.
NAME = ("none", "id", "h1", "h2")


def exact_links(texts: DataFrame, distinct: DataFrame, groups: DataFrame, similarity: float, words: int, codes) -> DataFrame:
    """(u, v): trees that join what links of at least ``similarity``, by the shingles themselves, join within groups(node, label).

    distinct(node, code, name) names for each node a row of texts(text, *NAME). Within a group only candidates by their bits are compared.
    """
    held = written(distinct.join(groups, "node").select("node", "code", F.col("label").alias("bucket"), "name.*"), "candidates")
    keys = held.toDF(*held.columns[:3], *[f"k_{c}" for c in NAME])
    meets = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in NAME]
    member = texts.join(F.broadcast(keys) if held.count() <= BROADCAST_ROWS else keys, meets[0] & meets[1] & meets[2] & meets[3])

    def sets(batches):
        for b in batches:
            for part in (b.slice(at, 500) for at in range(0, b.num_rows, 500)):
                found = [shingles(x.as_py(), words).tobytes() for x in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.binary())], names=["node", "code", "bucket", "shingles"])

    made = member.select("node", "code", "bucket", "text").mapInArrow(sets, "node long, code binary, bucket long, shingles binary")
    # one row of those that are repeated whole
    routed = written(made.dropDuplicates(["node"]).withColumn("weight", F.length("shingles") + 256), "shingles")
    total = routed.agg(F.sum("weight")).first()[0] or 0

    def check(table: pa.Table, order: np.ndarray):
        column = table.column("shingles")
        size = pc.binary_length(column).to_numpy()[order] // 8
        at = order.tolist()

        def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            # sets of too unlike sizes can't reach it
            out = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6
            for i in out.nonzero()[0]:
                x, y = (np.frombuffer(column[at[k]].as_buffer(), "<u8") for k in (a[i], b[i]))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = both / max(1, len(x) + len(y) - both) >= similarity
            return out

        return same

    return tree_links(routed, lambda table: codes(table.column("code")), wide_bits(similarity), total, SETS_TILE, check, star=True)


def named_groups(docs: DataFrame, similarity: float, words: int, id_col: str, text_col: str, tile: int) -> DataFrame:
    """(*NAME, rep) per row: rep is the smallest name reachable over texts whose Jaccard similarity of word shingles reaches ``similarity``."""

    def mark(batches):
        for b in batches:
            code = [wide_fingerprint(x.as_py(), words).tobytes() for x in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(code, pa.binary())], names=[*NAME, "code"])

    plain = docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), text_col).alias("h2"), F.col(text_col).alias("text"))
    marked = written(plain.mapInArrow(mark, f"none boolean, id {plain.schema['id'].dataType.simpleString()}, h1 long, h2 long, code binary"), "wide")
    distinct = marked.groupBy("code").agg(F.min(F.struct(*NAME)).alias("name")).withColumn("node", F.monotonically_increasing_id())
    distinct = written(distinct, "distinct")
    count = distinct.count()
    places = bands(count, similarity)

    def code_rows(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WIDE)

    def linked(nodes: DataFrame, some: range) -> DataFrame:
        """Components of the links that these bands find among nodes(node, code, label)."""

        def route(batches):
            up = 1 << np.arange(places.shape[1], dtype=np.int64)
            for b in batches:
                bit = np.unpackbits(code_rows(b.column(1)).view(np.uint8), axis=1, bitorder="little")
                keys = np.stack([bit[:, places[i]].astype(np.int64) @ up | i << 48 for i in some], axis=1)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(some)), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, keys], names=["node", "code", "label", "keys"])

        routed = nodes.mapInArrow(route, "node long, code binary, label long, keys array<long>").select("node", "code", "label", F.explode("keys").alias("bucket"))
        return components(tree_links(routed, lambda held: code_rows(held.column("code")), wide_bits(similarity), count * len(some), tile, star=True))

    # a few bands join most of a large group, so that the others need not name its links again
    first = linked(distinct.select("node", "code", F.col("node").alias("label")), range(min(FIRST, len(places)))).withColumnRenamed("node", "at")
    nodes = distinct.select("node", "code").join(first, F.col("node") == F.col("at"), "left")
    nodes = written(nodes.select("node", "code", F.coalesce("label", "node").alias("label"), F.col("at").isNotNull().alias("grouped")), "nodes")
    groups = nodes.select("node", "label", "grouped")
    if len(places) > FIRST:
        more = linked(nodes.select("node", "code", "label"), range(FIRST, len(places))).select(fresh_key("node").alias("at"), F.col("label").alias("last"))
        groups = groups.join(more, F.col("label") == F.col("at"), "left").select("node", F.coalesce("last", "label").alias("label"), (F.col("grouped") | F.col("at").isNotNull()).alias("grouped"))
    groups = groups.where("grouped").select("node", "label")
    label = components(exact_links(plain, distinct, groups, similarity, words, code_rows))
    member = written(distinct.join(label, "node", "left").select("code", "name", F.coalesce("label", "node").alias("label")), "members")
    named = written(member.groupBy("label").agg(F.min("name").alias("rep")), "named").select(fresh_key("label").alias("key"), "rep")
    of = written(member.join(named, member["label"] == named["key"]).select("code", "rep"), "of").select(F.concat("code", F.lit(b"")).alias("key"), "rep")
    return marked.join(of, marked["code"] == of["key"]).select(*NAME, "rep")


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(id, component_id) per row: the smallest id reachable over texts whose Jaccard similarity of word shingles reaches ``similarity``.

    Candidates differ in few bits of wide fingerprints. They meet in buckets of bands of these bits, whose number follows the
    number of texts; within a bucket the Gray-order index finds every pair. In each group that candidates join, the shingles
    themselves are compared, and only pairs that reach ``similarity`` are links. Texts without words are alike. Nulls, repeated rows and empty tables are as in
    near_groups(); rows that share an id but not the text are texts of their own.
    """
    return named_groups(docs, similarity, words, id_col, text_col, tile).select(F.col("id").alias(id_col), F.col("rep.id").alias("component_id"))


def drop_near(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each similar_groups() component, that with the smallest id (of the same id: one text); rows with a null id stay.

    A row goes by its id and its text together, so unlike texts under the same id stay. Columns and rows that stay are as they were.
    """
    found = named_groups(docs, similarity, words, id_col, text_col, TILE)
    gone = found.where("not none and (id <> rep.id or h1 <> rep.h1 or h2 <> rep.h2)").select("id", "h1", "h2")
    return without(docs, gone, [F.col(id_col), F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)])
