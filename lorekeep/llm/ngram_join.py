"""N-gram Jaccard join: links between all documents whose shingle sets are similar enough, by signature trees.

Two sets at a Jaccard similarity of t or more share one of the first n - ceil(t n) + 1 hashes of either (the prefix, in
ascending order of hash). So documents meet by prefix hash, and nothing is lost. Within such a group:

0. Prefixes are longer than that by some hashes, of which a pair then has to share as many more.
1. Copies have been folded into one representative before; only different sets meet.
2. Every member is compared with the group's smallest member: the exact links among these already join most groups of near
   copies, and cost one comparison a member instead of one a pair.
3. In small groups that still hold more than one component, pairs are counted; only those that share enough hashes go on.
   Larger groups go through a signature tree. Its nodes hold the OR and the AND of their
   members' bitmaps, their range of sizes and their component. A dual traversal drops a pair of nodes if the largest
   overlap that bitmaps and sizes allow is too small, or if both sides are one component. What is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_batch, bound_batches, bounded_sample, release, stored, table
from .components import components
from .shingles import Shingler

#: Members of a node of the lowest level.
LEAF = 16
#: Members of a block; a larger group is dealt out by pairs of blocks.
BLOCK = 1024
#: Members up to which a group's pairs are counted instead of searched by a tree.
FEW = 16
#: Texts from which frequent shingles are learned, for the order of prefixes.
SAMPLE = 24_000
#: Bytes of an Arrow batch. Two workers of Python stand beside each executor's heap, and each batch lies in both several times.
BATCH_BYTES = 4 << 20
#: Ids of documents to compare that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """At least 4 bits a hash, as 64-bit words; a power of two, so that wider bitmaps fold onto narrower ones."""
    bits = max(64, 1 << int(4 * len(hashes) - 1).bit_length())
    seen = np.zeros(bits, bool)
    seen[((hashes >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(seen, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, n: int) -> np.ndarray:
    return np.bitwise_or.reduce(words.reshape(-1, n), axis=0)


class SignatureTree:
    """Levels of nodes over members in order of size; a node of one level joins LEAF or 4 nodes of the level below."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, comps: np.ndarray):
        """maps: a bitmap for each member, all of one width."""
        one = np.arange(len(sizes))
        self.levels = [(one, one + 1, maps, maps, sizes, sizes, comps)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            first, last, any_, all_, low, high, comp = self.levels[-1]
            cut = np.arange(0, len(first), step)
            same = np.minimum.reduceat(comp, cut) == np.maximum.reduceat(comp, cut)
            ends = np.append(cut[1:], len(first)) - 1
            self.levels.append((cut, ends + 1, np.bitwise_or.reduceat(any_, cut), np.bitwise_and.reduceat(all_, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.where(same, comp[cut], -1)))
            step = 4

    def pairs(self, other: SignatureTree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of members that may reach den * overlap >= num * union, of different components."""
        depth = max(len(self.levels), len(other.levels)) - 1
        a = b = np.zeros(1, np.int64)
        while True:
            la, lb = self.levels[min(depth, len(self.levels) - 1)], other.levels[min(depth, len(other.levels) - 1)]
            keep = []
            for lo in range(0, len(a), 1 << 16):
                keep.append(self._possible(la, lb, a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)], num, den))
            keep = np.concatenate(keep)
            a, b = a[keep], b[keep]
            if depth == 0 or not len(a):
                return a, b
            a, b = self._children(self, depth, a, b)
            b, a = self._children(other, depth, b, a)
            if self is other:
                up = a <= b
                a, b = a[up], b[up]
            depth -= 1

    @staticmethod
    def _children(tree: SignatureTree, depth: int, own: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if depth >= len(tree.levels):
            return own, beside
        first, last = tree.levels[depth][0], tree.levels[depth][1]
        n = (last - first)[own]
        start = np.repeat(first[own], n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return start + inside, np.repeat(beside, n)

    @staticmethod
    def _possible(x, y, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        _, _, any_x, all_x, low_x, high_x, comp_x = x
        _, _, any_y, all_y, low_y, high_y, comp_y = y
        apart = (comp_x[a] != comp_y[b]) | (comp_x[a] < 0)
        # sizes: the smaller set must have num/den of the larger one's size
        apart &= (den * high_x[a] >= num * low_y[b]) & (den * high_y[b] >= num * low_x[a])
        at = np.flatnonzero(apart)
        if len(at):
            a, b = a[at], b[at]
            # every bit that all sets of one side have and none of the other's is an element outside the overlap
            most_x = high_x[a] - np.bitwise_count(all_x[a] & ~any_y[b]).sum(axis=1, dtype=np.int64)
            most_y = high_y[b] - np.bitwise_count(all_y[b] & ~any_x[a]).sum(axis=1, dtype=np.int64)
            # den * o >= num * (na + nb - o)
            apart[at] = (den + num) * np.minimum(most_x, most_y) >= num * (low_x[a] + low_y[b])
        return apart


def tree_pairs(reps: list[int], sizes: np.ndarray, maps: list[np.ndarray], comps: np.ndarray, sides: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (smaller, larger representative) of one group that need an exact comparison.

    sides: 1 for members of the first block, 2 of the second, 3 if both are the same block.
    """
    width = min(len(m) for m in maps)
    order = np.argsort(sizes, kind="stable")
    # sets of a pair differ in size by less than a factor; the narrowest bitmap of the group serves them all if it is not
    # much narrower, else members are taken by width
    out = []
    widths = np.array([len(m) for m in maps])
    for w in sorted({*widths.tolist()}):
        own = order[(widths[order] == w) | (widths[order] == 2 * w)]
        if not (widths[own] == w).any():
            continue
        folded = np.stack([fold(maps[i], w) for i in own])
        if (sides == 3).all():
            tree = SignatureTree(sizes[own], folded, comps[own])
            a, b = tree.pairs(tree, num, den)
        else:
            one, two = sides[own] == 1, sides[own] == 2
            if not one.any() or not two.any():
                continue
            a, b = SignatureTree(sizes[own][one], folded[one], comps[own][one]).pairs(SignatureTree(sizes[own][two], folded[two], comps[own][two]), num, den)
            a, b = np.flatnonzero(one)[a], np.flatnonzero(two)[b]
        for i, j in zip(own[a].tolist(), own[b].tolist(), strict=True):
            if i != j and reps[i] != reps[j] and (w == width or min(widths[i], widths[j]) == w):
                out.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
    return out


def _merged(flags: DataFrame) -> DataFrame:
    """One row (seen, twice) a partition: tables of 2^24 bits of those of its rows, a bit twice where two of them have seen it."""
    import zlib

    def merge(batches):
        import pyarrow as pa

        seen = twice = np.zeros(1 << 21, np.uint8)
        for b in batches:
            for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = (np.frombuffer(zlib.decompress(z), np.uint8) for z in (x, y))
                seen, twice = seen | x, twice | y | (seen & x)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (seen, twice)], names=["seen", "twice"])

    return flags.mapInArrow(merge, "seen binary, twice binary")


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """A table of 2^24 flags by the top bits of a hash: set where two of a bounded number of texts share a shingle.

    It only decides the order of hashes: those flagged come last in a prefix, so that few unrelated texts meet. Any fixed
    table gives the same links, so the texts it is made from are bounded (about SAMPLE, by a hash of their ids). Tasks
    return tables of that size, merged up a tree; copies of a text count once.
    """
    import zlib

    rows = bounded_sample(texts.where("id is not null"), SAMPLE, "id").where("text is not null")
    chosen = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min("id").alias("id")).select("id")
    rows = rows.join(F.broadcast(chosen), "id", "left_semi").select(F.col("text").cast("binary").alias("t"))  # about SAMPLE ids

    def flags(batches):
        import pyarrow as pa

        shingler = Shingler(width)
        seen, twice, n = np.zeros(1 << 24, bool), np.zeros(1 << 24, bool), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                at = (shingler(t) >> np.uint64(40)).astype(np.int64)
                twice[at[seen[at]]] = True
                seen[at] = True
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(x).tobytes(), 1)], pa.binary()) for x in (seen, twice)], names=["seen", "twice"])

    bound_batches(texts.sparkSession, BATCH_BYTES)
    parts = stored(rows.mapInArrow(flags, "seen binary, twice binary"), "flags")
    n = parts.count()
    while n > 16:
        n = -(-n // 16)
        parts = stored(_merged(parts.repartition(n)), "flags")
    got = _merged(parts.coalesce(1)).collect()
    return np.frombuffer(zlib.decompress(got[0].twice), np.uint8) if got else np.zeros(1 << 21, np.uint8)


def asked(n):
    """Shared prefix hashes that two sets of n shingles or more have to have (if they need to overlap as much at all)."""
    return 4 + n // 50


def prefix(s: np.ndarray, flags: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n - ceil(num n / den) + asked(n) hashes, those not flagged first, then by hash. flags: packed bits.

    Two sets with an overlap of at least o share k of their first n - o + k hashes each, for every k up to o.
    """
    if not len(s):
        return s
    at = s >> np.uint64(40)
    late = (flags[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return np.concatenate([s[~late], s[late]])[: len(s) + (-num * len(s)) // den + asked(len(s))]


def _signatures(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    fields = [T.StructField("n", T.LongType(), False), T.StructField("f1", T.LongType(), False), T.StructField("f2", T.LongType(), False), T.StructField("prefix", T.ArrayType(T.LongType(), False), False)]
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))

    def work():
        import pyarrow as pa

        shingler, flags = Shingler(width), shared.value

        def run(texts):
            n, f1, f2, firsts = [], [], [], []
            for t in texts:
                s = shingler(t.as_buffer().to_pybytes() if t.is_valid else None)
                x, y = digest(s)
                n.append(len(s))
                f1.append(x)
                f2.append(y)
                firsts.append(prefix(s, flags, num, den).view(np.int64))
            return n, f1, f2, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in firsts])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts]), pa.int64()))

        return run

    return add_by_batch(docs, ["text"], fields, work, BATCH_BYTES).drop("text")


class _Sets:
    """Texts of classes. A class is a set of shingles; its text is that of its smallest key, told apart by the set's digest from
    other texts of that key."""

    def __init__(self, texts: DataFrame, classes: DataFrame, width: int):
        self.texts, self.width = texts, width
        self.named = classes.select("rep", F.col("first").alias("id"), "f1", "f2")

    def of(self, asked: DataFrame, name: str, made) -> DataFrame:
        """rep and what `made` makes of the set of each class that is asked for (rep). Up to BROADCAST_IDS of them are sent to the
        texts, else both are shuffled."""
        asked = stored(asked.select("rep").distinct().join(self.named, "rep"), "asked")
        rows = self.texts.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "id").drop("id")

        width = self.width

        def work():
            import pyarrow as pa

            shingler = Shingler(width)

            def run(texts, f1, f2):
                out = []
                for t, x, y in zip(texts.cast(pa.large_binary()).to_pylist(), f1.to_pylist(), f2.to_pylist(), strict=True):
                    s = shingler(t)
                    out.append(made(s) if digest(s) == (x, y) else None)
                return [out]

            return run

        found = add_by_batch(rows, ["text", "f1", "f2"], [T.StructField(name, T.BinaryType(), True)], work, BATCH_BYTES).drop("text", "f1", "f2")
        # rows of one key with one text are copies
        return found.where(F.col(name).isNotNull()).dropDuplicates(["rep"])


def digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def _compared(pairs: DataFrame, sets: _Sets, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of classes whose sets are linked, each compared exactly. Pairs of one a are dealt out in blocks of about
    BLOCK; the set of a goes to each block once."""
    import pyarrow as pa

    found = stored(sets.of(pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b")), "set", lambda s: s.tobytes()), "sets")
    blocks = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    other = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("rep")).join(found, "rep")
    own = blocks.select(F.col("a").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(found, "rep").select(F.col("rep").alias("a"), "block", F.lit(None).cast("long").alias("b"), "set")
    bound_batches(pairs.sparkSession, BATCH_BYTES)

    def compare(batches):
        x = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for i, _, j, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y = np.frombuffer(s, np.uint64)
                if j is None:  # the block's own set comes first
                    x = y
                    continue
                o = len(x) + len(y) - len(np.union1d(x, y))
                if den * o >= num * (len(x) + len(y) - o):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = own.unionAll(other.select("a", "block", F.col("rep").alias("b"), "set")).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(compare, "a long, b long")


def possible(ma: bytes, na: int, mb: bytes, nb: int, num: int, den: int) -> bool:
    """Whether sizes and bitmaps of two sets leave room for den * overlap >= num * union."""
    if den * na < num * nb or den * nb < num * na:
        return False
    w = min(len(ma), len(mb))
    x, y = (int.from_bytes(m, "little") if len(m) == w else int.from_bytes(fold(np.frombuffer(m, np.uint64), w // 8).tobytes(), "little") for m in (ma, mb))
    return (den + num) * min(na - (x & ~y).bit_count(), nb - (y & ~x).bit_count()) >= num * (na + nb)


def _possible_pairs(pairs: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, na, b, nb) that their bitmaps leave possible."""
    both = pairs.join(maps.withColumnRenamed("rep", "a").withColumnRenamed("map", "ma"), "a").join(maps.withColumnRenamed("rep", "b").withColumnRenamed("map", "mb"), "b")

    def work():
        return lambda *columns: [[possible(ma, na, mb, nb, num, den) for ma, na, mb, nb in zip(*(c.to_pylist() for c in columns), strict=True)]]

    return add_by_batch(both, ["ma", "na", "mb", "nb"], [T.StructField("ok", T.BooleanType(), False)], work, BATCH_BYTES).where("ok").select("a", "b")


def _group_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """members: token, band, i, j, which are a group's key, then rep, n, comp, map, side. Candidate pairs of all groups."""
    bound_batches(members.sparkSession, BATCH_BYTES)

    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        maps = [np.frombuffer(r[3], np.uint64) for r in rows]
        n, comp, side = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 4))
        return tree_pairs([r[0] for r in rows], n, maps, comp, side, num, den)

    def run(batches):
        import pyarrow as pa

        def table_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])

        key, rows, out = None, [], set()
        for b in batches:
            for token, band, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (token, band, i, j) != key:
                    if len(rows) > 1:
                        out.update(close(rows))
                    key, rows = (token, band, i, j), []
                rows.append(tuple(row))
            if len(out) > 50_000:
                yield table_of(sorted(out))
                out = set()
        if len(rows) > 1:
            out.update(close(rows))
        yield table_of(sorted(out))

    group = ["token", "band", "i", "j"]
    dealt = members.select(*group, "rep", "n", "comp", "map", "side").repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _dealt(members: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """token, band, i, j, rep, n, comp, side for members (token, rep, n, comp) of groups that are too large for a task.

    Linked sets differ in size by a factor of den / num at most, so a group falls into bands of sizes, and a set meets those
    of its own band and of the next one only. Each band is dealt out by pairs (i, j) of blocks: its own blocks come
    first, then those of the next band.
    """
    # bands are wider than the factor by more than rounding can make of it
    step = np.log(den / num) * (1 + 1e-6) if num < den else 0.0
    band = F.floor(F.log("n") / F.lit(float(step))) if step else F.col("n")
    members = members.withColumn("band", band.cast("long"))
    sizes = stored(members.groupBy("token", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("own")), "bands")
    after = sizes.select("token", (F.col("band") - 1).alias("band"), F.col("own").alias("next"))
    before = sizes.select("token", (F.col("band") + 1).alias("band"), F.col("own").alias("last"))
    placed = members.join(sizes, ["token", "band"]).join(after, ["token", "band"], "left").join(before, ["token", "band"], "left")
    placed = placed.withColumn("at", F.pmod(F.xxhash64("rep"), F.col("own")).cast("int"))
    at, k, own = F.col("at"), F.col("k"), F.col("own")
    first = placed.withColumn("k", F.explode(F.sequence(F.lit(0), own + F.coalesce("next", F.lit(0)) - 1)))
    first = first.select("token", "band", F.when(k < own, F.least(at, k)).otherwise(at).alias("i"), F.when(k < own, F.greatest(at, k)).otherwise(k).alias("j"), "rep", "n", "comp", F.when(k == at, 3).when((k < own) & (k < at), 2).otherwise(1).alias("side"))
    second = placed.where("last is not null").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last") - 1)))
    return first.unionAll(second.select("token", F.col("band") - 1, k, F.col("last") + at, "rep", "n", "comp", F.lit(2)))


def _counted_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """a, na, b, nb for pairs of different components in small groups (token, rep, n, comp) that share as many prefix hashes
    as a link needs. Groups have FEW members at most, so a member meets fewer than FEW others in each."""
    group = F.collect_list(F.struct("rep", "n", "comp"))
    lists = members.groupBy("token").agg(F.array_sort(group).alias("g"))

    def fits(x, y):
        return (x["comp"] != y["comp"]) & (x["rep"] != y["rep"]) & (den * x["n"] >= num * y["n"]) & (den * y["n"] >= num * x["n"])

    def met(x, i):
        later = F.filter(F.slice(F.col("g"), i + 2, F.size("g")), lambda y: fits(x, y))
        return F.transform(later, lambda y: F.struct(x["rep"].alias("a"), x["n"].alias("na"), y["rep"].alias("b"), y["n"].alias("nb")))

    near = lists.select(F.explode(F.flatten(F.transform("g", met))).alias("p")).select("p.*")
    counts = near.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("shared"))
    overlap = F.ceil(num * (F.col("na") + F.col("nb")) / F.lit(float(den + num)) - 1e-9)
    return counts.where(F.col("shared") >= F.least(overlap, 4 + F.floor(F.least("na", "nb") / 50))).drop("shared")


def _near(pairs: DataFrame, sets: _Sets, num: int, den: int) -> DataFrame:
    """The pairs (a, na, b, nb) that sizes and bitmaps leave possible, as a, b."""
    pairs = stored(pairs, "pairs")
    maps = stored(sets.of(pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b")), "map", lambda s: bitmap(s).tobytes()), "bitmaps")
    return stored(_possible_pairs(pairs, maps, num, den), "near")


def _numbered(classes: DataFrame) -> DataFrame:
    """Adds rep, the number of a class: its smallest key, so that the members of a group are compared with the document that came
    first, of which most copies are made. Where several sets share that key, all but one get numbers beyond all keys."""
    several = stored(classes.groupBy("first").agg(F.min("number").alias("kept"), F.count("*").alias("sets")).where("sets > 1").select("first", "kept"), "several")
    n = several.count()
    if not n:
        return classes.withColumn("rep", F.col("first")).drop("number")
    least, most = classes.agg(F.min("first"), F.max("first")).first()
    # the side of the keys on which there is room
    beyond = F.lit(most + 1) + F.col("number") if most < 1 << 62 else F.lit(least - 1) - F.col("number")
    joined = classes.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "first", "left")
    return joined.withColumn("rep", F.when(F.col("kept").isNull() | (F.col("kept") == F.col("number")), F.col("first")).otherwise(beyond)).drop("number", "kept")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: key, n_shingles, component_id (smallest key reachable by links, the own one included).

    Two documents link when den * |intersection| >= num * |union| of their shingle sets. Null and empty texts, and texts
    without words, have no shingles and no links: they are components of their own. Rows with a null key get a null
    component and link with nothing. Rows with equal keys are one node of the graph, linked to what any of them links to.
    Sets of a link may differ in size by a factor of two at most, as their bitmaps do: smaller thresholds are refused.
    """
    if not 0 < num <= den <= 2 * num:
        raise ValueError("the threshold num / den must lie between a half and one")
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = stored(_signatures(own, width, num, den), "signatures")
    classes = signed.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("first"), F.first("prefix").alias("prefix"))
    classes = _numbered(stored(classes.withColumn("number", F.monotonically_increasing_id()), "classes"))
    release(spark)
    sets = _Sets(own.where("id is not null"), classes, width)
    entries = classes.select("rep", "n", F.explode("prefix").alias("token"))
    # hashes of a single set are dropped here; what is left is small, and so are its pivots
    groups = stored(entries.groupBy("token").agg(F.min("rep").alias("pivot"), F.count("*").alias("df")).where("df > 1"), "groups")
    release(spark)
    met = stored(entries.join(groups, "token"), "met")
    release(spark)
    stars = met.where("rep != pivot").groupBy(F.col("pivot").alias("a"), F.col("rep").alias("b"), F.col("n").alias("nb")).agg(F.count("*").alias("shared")).where("shared >= 4 or shared >= nb / 2")
    sizes = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"))
    stars = stars.join(sizes, "a").where((den * F.col("na") >= num * F.col("nb")) & (den * F.col("nb") >= num * F.col("na"))).select("a", "na", "b", "nb")
    star_links = stored(_compared(_near(stars, sets, num, den), sets, num, den), "star-links")
    comps = stored(components(star_links), "components")
    release(spark)
    placed = stored(met.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "n", "df", F.coalesce("component", "rep").alias("comp")), "placed")
    open_ = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.count("*").alias("size")).where("lo != hi")
    open_ = open_.where((F.col("size") > 2) | (den * F.col("n_lo") >= num * F.col("n_hi"))).select("token")
    rest = placed.join(open_, "token", "left_semi")
    counted = _near(_counted_pairs(rest.where(F.col("df") <= FEW), num, den), sets, num, den)
    one = rest.where((F.col("df") > FEW) & (F.col("df") <= block))
    one = one.select("token", F.lit(-1).cast("long").alias("band"), F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "n", "comp", F.lit(3).alias("side"))
    large = stored(one.unionAll(_dealt(rest.where(F.col("df") > block).select("token", "rep", "n", "comp"), num, den, block)), "large")
    searched = _group_pairs(large.join(stored(sets.of(large, "map", lambda s: bitmap(s).tobytes()), "bitmaps"), "rep"), num, den)
    more = stored(counted.unionAll(searched).distinct(), "tree-pairs")
    release(spark)
    # classes that share a key are one node
    placed = stored(signed.where("n > 0 and id is not null").select("id", "n", "f1", "f2").join(classes.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"]).groupBy("id", "rep").agg(F.lit(1)).select("id", "rep"), "placed")
    several = placed.groupBy("id").agg(F.min("rep").alias("a"), F.count("*").alias("sets")).where("sets > 1")
    shared = placed.join(several, "id").select("a", F.col("rep").alias("b")).where("a != b")
    links = star_links.unionAll(_compared(more, sets, num, den)).unionAll(shared)
    final = stored(components(links), "components")
    named = classes.select("rep", "first").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "first", F.coalesce("component", "rep").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    by_key = placed.join(named.select("rep", "component"), "rep").join(smallest, "component").groupBy("id").agg(F.min("smallest").alias("smallest"))
    return signed.select("id", "n").join(by_key, "id", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("smallest", "id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents less all but the one with the smallest doc_id of each group of near copies; rows without an id stay."""
    found = similar_documents(docs, width=width, num=num, den=den).where("doc_id = component_id").select("doc_id").distinct()
    unnamed = docs.where("doc_id is null")
    return docs.join(found, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(unnamed)


def op6_query(spark, sf_dir: str) -> DataFrame:
    """Every document: 3-word shingles at a similarity of 0.9."""
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
