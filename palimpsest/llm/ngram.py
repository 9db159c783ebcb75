"""N-gram Jaccard self-join by prefix filtering with set-relation skipping.

A text's set is its distinct word shingles, as 64-bit hashes; equal sets are one node.  Sets that
reach the threshold share an element in the first ``n - ceil(t * n) + 1`` places of any common
order.  The order used is (frequent elements last, hash), where the frequent ones are counted
over all documents; it only steers the cost, any order gives the same links.

1. membership: each row's set and its size.
2. frequency: counts of all elements.
3. postings: prefix elements with set, size and position, dealt by element.  An element's position
   says how large a partner may be that meets the set there first (``reach``): two sets of a list
   need a look only if each is within the other's reach.  Entries that no other reaches are
   skipped with their list.  Short lists give their pairs; the number of prefix elements that a
   pair shares, summed over all lists, bounds its overlap.  Long lists give stars: per size class
   the set with the element at the earliest position leads, and each set is compared with the
   leaders of its class and the next lower one.
4. verification by the sets themselves: of each pair the set with more partners (a leader, as a
   rule) is sent once for a block of them.  The answer holds the overlap and, as bit tables, what
   the partner lacks of the leader and has beside it.  Then components.
5. In long lists only pairs across components remain.  A list is dealt out in blocks of outsiders
   (sets outside its largest component) and members.  Within one, members lie in blocks by size
   and reach, and blocks out of an outsider's reach are skipped as a whole.  For the rest the
   answers of y and z against their leader x give the answer of y against z:
   |y & z| <= |x| - |(x - y) | (x - z)| + |(y - x) & (z - x)|, both terms bounded by the bit tables.
   Only where a link stays possible, 4 decides.

So the large groups of near copies cost a star each, no document is dropped, and no list of
documents or links reaches the driver.  What is broadcast is bounded: at most ``HOT_ELEMENTS``
frequent elements and a bit table of at most ``BLOOM_BITS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mapped, saved, shuffle_width, slices
from .components import connected
from .hashing import hashed_words, mix, planes, sequence_hashes, signed, sorted_distinct, unplaned

SHINGLE_WORDS = 5
#: The similarity as a fraction of whole numbers.
SHARED, OF = 75, 100
#: Documents from which on an element counts as frequent, and how many of those are broadcast (12 bytes each).
FREQUENT = 12
HOT_ELEMENTS = 1 << 20
#: Longest list whose pairs are all looked at in the first round.
SHORT_LIST = 8
#: Elements that a task holds before it deals them out.
BLOCK_ELEMENTS = 1_000_000
SEGMENT_BYTES = 1 << 14
BLOOM_BITS = 1 << 26
#: Partners that are compared with one sending of a leader, outsiders and members of a list that meet in one task.
HUB_BLOCK = 1024
OUTSIDERS, MEMBERS = 2048, 65536
#: Entries of a list that are skipped together, and pairs that a task looks at at once.
SKIP_BLOCK = 64
LOOK = 1 << 17
#: Bits of the table of what a set has beside its leader, and of that of what it lacks.
DIFF_BITS = 256
#: Bytes of an element's hash that postings carry; the sets themselves are compared by all 8.
ELEMENT_BYTES = 6
SHIFT = np.uint64(64 - 8 * ELEMENT_BYTES)


def shingle_sets(column: pa.Array, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; all its words are one if there are fewer than n."""
    h, at = hashed_words(column, lower=True)
    runs = sequence_hashes(h, n)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= n:
            out.append(sorted_distinct(runs[a : b - n + 1]))
        else:
            out.append(mix(sequence_hashes(h[a:b], b - a) + np.uint64(b - a)) if a < b else h[:0])
    return out


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()))[0]


def set_id(s: np.ndarray) -> int:
    """64-bit name of a set; sets are taken as equal if their names and sizes are."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s))


def least_shared(n: np.ndarray | int):
    """Elements that a set of n shares with any set it links with."""
    return -(-SHARED * n // OF)


def prefix_length(n):
    return n - least_shared(n) + 1


def needed(total):
    """Overlap that sets of together ``total`` elements need: OF * o >= SHARED * (total - o)."""
    return -(-SHARED * total // (SHARED + OF))


def reach(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The largest size of a set that may link with one of n elements and meets it first at position pos."""
    return (SHARED + OF) * (n - pos) // SHARED - n


def row_key(docs: DataFrame, name: str = "_key") -> DataFrame:
    """docs with a hash of all their columns, which with doc_id names a row up to its exact repeats."""
    return docs.withColumn(name, F.xxhash64(*[F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in docs.dtypes]))


def _membership(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(np.array([set_id(s) for s in sets], np.uint64)))],
                names=["_key", "doc_id", "n", "set"],
            )

    return mapped(rows.select("_key", F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "_key long, doc_id long, n long, set long")


def _dealt(bucket: np.ndarray, width: int, columns: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """Columns cut by bucket, each as one blob of byte planes; rows lie in the order given."""
    ends = np.searchsorted(bucket, np.arange(width + 1))
    for k in range(width):
        a, b = ends[k], ends[k + 1]
        if a < b:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([planes(c[a:b], w)], pa.binary()) for c, w in columns)], names=["bucket", *(f"c{j}" for j in range(len(columns)))])


def _distinct_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Blocks of sets; a set that repeats within a block is left out."""
    held: dict[int, np.ndarray] = {}
    elements = 0
    for batch in slices(batches):
        for s in shingle_sets(batch.column(0)):
            if len(s) and (name := set_id(s)) not in held:
                held[name] = s
                elements += len(s)
        if elements >= BLOCK_ELEMENTS:
            yield [*held.values()]
            held, elements = {}, 0
    if held:
        yield [*held.values()]


def _frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements (as postings carry them), in order, and their counts."""
    scale = np.uint64(-(-(1 << (8 * ELEMENT_BYTES)) // width))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _distinct_sets(batches):
            e = np.sort(np.concatenate(sets) >> SHIFT)
            yield from _dealt(e // scale, width, [(e, ELEMENT_BYTES)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = [unplaned(x, ELEMENT_BYTES) for batch in batches for x in batch.column(1).to_pylist()]
        if e:
            e, n = np.unique(np.concatenate(e), return_counts=True)
            often = n >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(e[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], names=["e", "n"])

    counted = mapped(mapped(rows.select("text"), deal, "bucket int, c0 binary").repartition(width, "bucket"), count, "e long, n long")
    top = counted.orderBy(F.desc("n"), "e").limit(HOT_ELEMENTS).toArrow()
    e, n = top.column(0).to_numpy().astype(np.uint64), top.column(1).to_numpy()
    order = np.argsort(e)
    return e[order], n[order]


def _prefix(s: np.ndarray, hot: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The set's prefix elements in the common order."""
    e = s >> SHIFT
    if len(hot):
        at = np.searchsorted(hot, e)
        at[at == len(hot)] = 0
        is_hot = hot[at] == e
        if is_hot.any():
            e = e[np.argsort(np.where(is_hot, often[at], 0), kind="stable")]
    return e[: int(prefix_length(len(s)))]


PAIRS = "kind int, a long, b long, na long, nb long, c long"


def _pair_batch(kind: int, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(a), 100_000):
        cut = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a[cut]), kind, np.int32)), *(pa.array(np.asarray(x[cut]).astype(np.int64)) for x in (a, b, na, nb, c))], names=["kind", "a", "b", "na", "nb", "c"]
        )


def _summed(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, directed: bool = False):
    """Distinct pairs, the smaller name first unless ``directed``, with the number of times each came."""
    if not directed:
        turn = a > b
        a, b, na, nb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], na[at], nb[at], np.diff(np.append(at, len(a)))


def _near(group: np.ndarray, n: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within one list (equal group, sorted by n, at most ``longest`` entries) whose sizes allow a link."""
    live = np.arange(len(group))
    for d in range(1, longest):
        live = live[live + d < len(group)]
        live = live[(group[live] == group[live + d]) & (n[live] >= least_shared(n[live + d]))]
        if not len(live):
            return
        yield live, live + d


def _reached(e: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each entry of lists (sorted by e and n) whether an entry within its reach reaches it."""
    group = (np.cumsum(np.append(True, e[1:] != e[:-1])) - 1) << 34
    far = group + reach(n, pos)
    up_to = np.searchsorted(group + n, far, side="right")
    best = np.append(-1, np.maximum.accumulate(far))  # groups rise, so what lies in an earlier list never counts
    return best[up_to] >= group + n


def _candidates(rows: DataFrame, width: int) -> DataFrame:
    """Kind 0: pairs of short lists with the number of prefix elements they share there; 1: pairs of leader (a) and member (b); 2: members of long lists (a: set, b: element, na: size, nb: position); 3: entries of a set (a) in long lists (c)."""
    hot, often = _frequent(rows, width)
    shared = rows.sparkSession.sparkContext.broadcast((hot, often))
    scale = np.uint64(-(-(1 << (8 * ELEMENT_BYTES)) // width))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = shared.value
        for sets in _distinct_sets(batches):
            parts = [_prefix(s, hot, often) for s in sets]
            sizes = [len(p) for p in parts]
            e = np.concatenate(parts)
            pos = np.minimum(np.concatenate([np.arange(k) for k in sizes]), 65535)
            names = np.repeat(np.array([set_id(s) for s in sets], np.uint64), sizes)
            n = np.repeat(np.array([len(s) for s in sets], np.uint64), sizes)
            # Prefixes lie in the lower part of the hash space; mixed, they deal out evenly.
            spread = (mix(e) >> SHIFT) // scale
            order = np.lexsort((e, spread))
            yield from _dealt(spread[order], width, [(e[order], ELEMENT_BYTES), (names[order], 8), (n[order], 4), (pos[order], 2)])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for k, w in enumerate((ELEMENT_BYTES, 8, 4, 2)):
                cols[k] += [unplaned(x, w) for x in batch.column(1 + k).to_pylist()]
        if not cols[0]:
            return
        e, names, n, pos = (np.concatenate(c) for c in cols)
        del cols
        # Only elements of two sets or more matter.
        order = np.argsort(e, kind="stable")
        e = e[order]
        twice = np.zeros(len(e), bool)
        twice[1:] = e[1:] == e[:-1]
        twice[:-1] |= twice[1:].copy()
        order = order[twice]
        e, names, n, pos = e[twice], signed(names[order]), n[order].astype(np.int64), pos[order].astype(np.int64)
        order = np.lexsort((names, n, e))
        e, names, n, pos = e[order], names[order], n[order], pos[order]
        first = np.ones(len(e), bool)  # one entry for each set
        first[1:] = (e[1:] != e[:-1]) | (names[1:] != names[:-1]) | (n[1:] != n[:-1])
        e, names, n, pos = e[first], names[first], n[first], pos[first]
        starts = np.flatnonzero(np.append(True, e[1:] != e[:-1])) if len(e) else np.zeros(0, int)
        size = np.diff(np.append(starts, len(e)))
        long = np.repeat(size > SHORT_LIST, size)
        if long.any():
            entries = np.unique(names[long], return_counts=True)
            none = np.zeros(len(entries[0]))
            yield from _pair_batch(3, entries[0], none, none, none, entries[1])
            kept = ~long
            kept[long] = _reached(e[long], n[long], pos[long])
            e, names, n, pos = e[kept], names[kept], n[kept], pos[kept]
            starts = np.flatnonzero(np.append(True, e[1:] != e[:-1])) if len(e) else np.zeros(0, int)
            size = np.diff(np.append(starts, len(e)))
            long = np.repeat(size > SHORT_LIST, size)
        short = np.flatnonzero(~long)
        found = [(short[i], short[j]) for i, j in _near(e[short], n[short], SHORT_LIST)]
        if found:
            i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            yield from _pair_batch(0, *_summed(names[i], names[j], n[i], n[j]))
        if long.any():
            e, names, n, pos = e[long], names[long], n[long], pos[long]
            yield from _pair_batch(2, names, e, n, pos, np.zeros(len(e)))
            # Sets that may link differ by one size class at most.
            size_class = np.floor(np.log(n) / np.log(OF / SHARED)).astype(np.int64)
            # A set with few elements of its own has the shared ones early: it lies near the middle of its group.
            order = np.lexsort((names, pos, size_class, e))
            e, names, n, size_class = e[order], names[order], n[order], size_class[order]
            new = np.append(True, (e[1:] != e[:-1]) | (size_class[1:] != size_class[:-1]))
            heads, group = np.flatnonzero(new), np.cumsum(new) - 1
            lower = np.append(False, (e[heads][1:] == e[heads][:-1]) & (size_class[heads][1:] == size_class[heads][:-1] + 1))
            down = np.flatnonzero(lower[group])
            i, j = np.concatenate([heads[group], heads[group[down] - 1]]), np.concatenate([np.arange(len(e)), down])
            ok = names[i] != names[j]
            i, j = i[ok], j[ok]
            yield from _pair_batch(1, *_summed(names[i], names[j], n[i], n[j], directed=True))

    dealt = mapped(rows.select("text"), deal, "bucket int, c0 binary, c1 binary, c2 binary, c3 binary")
    return saved(mapped(dealt.repartition(width, "bucket"), pair, PAIRS))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, text: one text for each wanted set (set), found by a pass over docs.

    A bit table of bounded size keeps most other texts from the exchange; what it lets through
    beside the wanted ones meets no partner in the join that follows.
    """
    n = wanted.count()
    bits = min(BLOOM_BITS, 1 << max(10, (16 * n).bit_length()))

    def places(names: np.ndarray) -> np.ndarray:
        h = mix(names.view(np.uint64))
        return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[places(batch.column(0).to_numpy().copy()).ravel()] = True
        parts = np.packbits(seen).reshape(-1, segment)
        held = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([parts[k].tobytes() for k in held], pa.binary())], names=["segment", "bits"])

    def merge(group: pa.Table) -> pa.Table:
        joined = np.zeros(segment, np.uint8)
        for part in group.column("bits").to_pylist():
            joined |= np.frombuffer(part, np.uint8)
        return pa.table({"segment": group.column("segment").combine_chunks()[:1], "bits": pa.array([joined.tobytes()], pa.binary())})

    # Each task sends the parts of its table that hold a bit; the parts of all tasks meet by their place.
    segment = min(bits // 8, SEGMENT_BYTES)
    table = np.zeros((bits // 8 // segment, segment), np.uint8)
    found = mapped(wanted.select("set"), gather, "segment int, bits binary").groupBy("segment").applyInArrow(merge, "segment int, bits binary")
    for k, part in found.toLocalIterator():  # BLOOM_BITS in all
        table[k] = np.frombuffer(bytes(part), np.uint8)
    table = table.ravel()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(shared.value).astype(bool)
        sent: set[int] = set()
        for batch in slices(batches):
            names = signed(np.array([set_id(s) for s in shingle_sets(batch.column(0))], np.uint64))
            hit = seen[places(names)].all(axis=0)
            rows = [k for k in np.flatnonzero(hit).tolist() if names[k] not in sent and not sent.add(names[k])]
            if len(sent) > 1_000_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(names[rows]), batch.column(0).take(pa.array(rows, pa.int64()))], names=["set", "text"])

    return mapped(docs.select("text"), keep, "set long, text string").groupBy("set").agg(F.first("text").alias("text"))


def _bits(elements: np.ndarray) -> bytes:
    held = np.zeros(DIFF_BITS, bool)
    held[(elements & np.uint64(DIFF_BITS - 1)).astype(np.int64)] = True
    return np.packbits(held).tobytes()


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """hub, spoke, na, nb (their sizes), o (overlap), more, less (bit tables of spoke - hub and hub - spoke) of distinct pairs of sets (a, b)."""
    width = shuffle_width(docs.sparkSession)
    pairs = saved(pairs.select("a", "b").distinct())
    degree = pairs.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("k"))
    sides = pairs.join(degree.select(F.col("set").alias("a"), F.col("k").alias("ka")), "a").join(degree.select(F.col("set").alias("b"), F.col("k").alias("kb")), "b")
    a_leads = (F.col("ka") > F.col("kb")) | (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b"))
    sides = sides.select(F.when(a_leads, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(a_leads, F.col("b")).otherwise(F.col("a")).alias("set"), F.greatest("ka", "kb").alias("k"))
    spokes = saved(sides.select("hub", "set", F.pmod(F.xxhash64("set"), F.ceil(F.col("k") / HUB_BLOCK)).alias("part")))
    hubs = spokes.select("hub", F.col("hub").alias("set"), "part").distinct()
    asked = hubs.withColumn("side", F.lit(0)).unionByName(spokes.withColumn("side", F.lit(1)))
    texts = _texts(docs, asked.select("set").distinct())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blob = None, b""
        for batch in slices(batches):
            blobs = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != last:
                    last, blob = name, shingles(text).tobytes()
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), pa.array(blobs, pa.binary())], names=["hub", "part", "side", "set", "blob"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in slices(batches):
            out = []
            for hub, _, side, name, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y = np.frombuffer(blob, np.uint64)
                if not side:
                    x = y
                    continue
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                hit = x[at] == y
                lacks = np.ones(len(x), bool)
                lacks[at[hit]] = False
                out.append((hub, name, len(x), len(y), int(hit.sum()), _bits(y[~hit]), _bits(x[lacks])))
            columns = [[r[k] for r in out] for k in range(7)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.binary()) for c in columns[5:])], names=["hub", "spoke", "na", "nb", "o", "more", "less"])

    sent = mapped(texts.join(asked, "set").select("set", "text", "hub", "part", "side"), send, "hub long, part long, side int, set long, blob binary")
    met = sent.repartition(width, "hub", "part").sortWithinPartitions("hub", "part", "side")
    return saved(mapped(met, compare, "hub long, spoke long, na long, nb long, o long, more binary, less binary"))


#: Columns of a list's entries as they meet: the whole numbers, then the bit tables.
ENTRY = ("e", "part", "block", "side", "set", "n", "far", "root", "outside", "hub", "nx", "o")


def _asked_pairs(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Names and sizes of the pairs of outsiders x and members y of one list that nothing rules out."""
    order = np.lexsort((-y["far"], y["n"]))
    y = {k: v[order] for k, v in y.items()}
    starts = np.arange(0, len(order), SKIP_BLOCK)
    least, most = y["n"][starts], np.maximum.reduceat(y["far"], starts)
    step = max(1, LOOK // len(order))
    for at in range(0, len(x["n"]), step):
        u = {k: v[at : at + step] for k, v in x.items()}
        # Blocks out of an outsider's reach, or that do not reach it, are skipped as a whole.
        i, block = np.nonzero((least[None, :] <= u["far"][:, None]) & (most[None, :] >= u["n"][:, None]))
        j = (starts[block][:, None] + np.arange(SKIP_BLOCK)).ravel()
        i = np.repeat(i, SKIP_BLOCK)
        i, j = i[j < len(order)], j[j < len(order)]
        ok = (y["n"][j] <= u["far"][i]) & (y["far"][j] >= u["n"][i]) & (u["root"][i] != y["root"][j])
        ok &= (y["outside"][j] == 0) | (u["set"][i] < y["set"][j])  # two outsiders meet twice
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        # What the answers against a common leader tell.
        oi, oj, ni, nj = u["o"][i], y["o"][j], u["n"][i], y["n"][j]
        bits = lambda z: np.bitwise_count(z).sum(axis=1, dtype=np.int64)
        mi, mj = u["more"][i], y["more"][j]
        common = np.minimum(np.minimum(oi, oj), u["nx"][i] - bits(u["less"][i] | y["less"][j]))
        beside = np.minimum(ni - oi - bits(mi & ~mj), nj - oj - bits(mj & ~mi))
        told = (u["hub"][i] == y["hub"][j]) & (oi >= 0) & (oj >= 0)
        ok = ~told | (common + beside >= needed(ni + nj))
        yield u["set"][i[ok]], y["set"][j[ok]], ni[ok], nj[ok]


def _across(lists: DataFrame, known: DataFrame, roots: DataFrame, width: int) -> DataFrame:
    """Pairs of long lists whose sets lie in different components and that positions and the leaders' answers leave open.

    lists: set, e, n, pos; known: set, hub, nx (its size), o (overlap with it), more, less; one hub for each set.
    """
    placed = lists.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    placed = placed.withColumn("far", F.expr(f"{SHARED + OF} * (n - pos) div {SHARED} - n"))
    # Within a list's largest component nothing is left to ask: the sets outside it, if any, ask all others.
    sizes = placed.groupBy("e", "root").agg(F.count("*").alias("k"))
    main = sizes.groupBy("e").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("inside")).where("all > inside")
    main = main.select("e", "main", F.ceil((F.col("all") - F.col("inside")) / OUTSIDERS).alias("parts"), F.ceil(F.col("all") / MEMBERS).alias("blocks"))
    held = placed.join(main, "e").join(known, "set", "left")
    none = F.lit(bytes(DIFF_BITS // 8))
    own = F.xxhash64("set")
    held = held.select(
        "e", "set", "n", "far", "root", (F.col("root") != F.col("main")).cast("long").alias("outside"), F.coalesce("hub", F.lit(0)).alias("hub"), F.coalesce("nx", F.lit(0)).alias("nx"),
        F.coalesce("o", F.lit(-1)).alias("o"), F.coalesce("more", none).alias("more"), F.coalesce("less", none).alias("less"), "parts", "blocks",
    )
    outsiders = held.where("outside = 1").withColumn("part", F.pmod(own, "parts")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("side", F.lit(0).cast("long"))
    members = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("block", F.pmod(own, "blocks")).withColumn("side", F.lit(1).cast("long"))
    columns = [*ENTRY, "more", "less"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(rows: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            """Of whole lists (e, part, block)."""
            batch = pa.Table.from_batches(rows).combine_chunks()
            x = {c: batch.column(c).to_numpy() for c in ENTRY}
            for c in ("more", "less"):
                x[c] = np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, DIFF_BITS // 64)
            change = np.any([x[c][1:] != x[c][:-1] for c in ("e", "part", "block", "side")], axis=0)
            ends = np.append(np.flatnonzero(change) + 1, len(x["e"]))
            for at, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
                if x["side"][a] == 1 and at and x["side"][a - 1] == 0:
                    first = int(ends[at - 2]) if at > 1 else 0
                    if all(x[c][a] == x[c][a - 1] for c in ("e", "part", "block")):
                        yield from _asked_pairs({k: v[first:a] for k, v in x.items()}, {k: v[a:b] for k, v in x.items()})

        def whole() -> Iterator[list[pa.RecordBatch]]:
            """Batches cut where a list ends."""
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = np.stack([batch.column(k).to_numpy() for k in range(3)])
                ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
                if held:
                    last = held[-1].slice(held[-1].num_rows - 1)
                    if any(last.column(k)[0].as_py() != key[k, 0] for k in range(3)):
                        yield held
                        held = []
                if len(ends):
                    yield [*held, batch.slice(0, int(ends[-1]))]
                    held = [batch.slice(int(ends[-1]))]
                else:
                    held.append(batch)
            if held:
                yield held

        found: list[tuple] = []
        count = 0
        for rows in whole():
            for pair in asked(rows):
                found.append(pair)
                count += len(pair[0])
                if count > 1_000_000:  # bounds what a task holds
                    yield from _pair_batch(0, *_summed(*(np.concatenate([f[k] for f in found]) for k in range(4))))
                    found, count = [], 0
        if count:
            yield from _pair_batch(0, *_summed(*(np.concatenate([f[k] for f in found]) for k in range(4))))

    met = outsiders.select(*columns).unionByName(members.select(*columns)).repartition(width, "e", "part", "block").sortWithinPartitions("e", "part", "block", "side")
    return mapped(met, run, PAIRS)


def _enough(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of short lists whose shared prefix elements leave room for the overlap that they need.

    All common elements up to the end of the prefix that ends first lie in both prefixes, so the
    overlap is at most their number and what follows in that set.  Elements of long lists were
    not counted: each set may share as many of them as it has.
    """
    part = lambda n: F.ceil(F.col(n) * SHARED / OF) - 1  # noqa: E731  what follows the prefix
    summed = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
    uncounted = entries.groupBy(F.col("a").alias("set")).agg(F.sum("c").alias("k"))
    for side in "ab":
        summed = summed.join(uncounted.select(F.col("set").alias(side), F.col("k").alias(f"k{side}")), side, "left")
    most = F.col("c") + F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0))) + F.greatest(part("na"), part("nb"))
    return summed.where(most >= F.ceil((F.col("na") + F.col("nb")) * SHARED / (SHARED + OF)))


def links(verified: DataFrame) -> DataFrame:
    return verified.where(OF * F.col("o") >= SHARED * (F.col("na") + F.col("nb") - F.col("o"))).select(F.col("hub").alias("a"), F.col("spoke").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """_key, doc_id, n_shingles, set, component_id and root of every row of docs (doc_id, text).

    Two rows link when their sets' Jaccard similarity is at least SHARED / OF; component_id is
    the least doc_id reachable by links, the row's own included.  Null and empty texts and texts
    without words have an empty set, link with nothing and are their own component.  A null
    doc_id is a component's id only if all of the component's are null.  Repeated rows and equal
    texts are one component.  An empty table gives no rows; other columns only enter _key, the
    hash that names a row up to its exact repeats.  root is the least set of the component, null
    for an empty set: other than component_id it tells components apart whose doc_ids repeat.
    """
    width = shuffle_width(docs.sparkSession)
    (key,) = fresh(docs, "key")
    rows = row_key(docs, key).select(F.col(key).alias("_key"), "doc_id", "text")
    docs = docs.select("text")
    member = saved(_membership(rows))
    found = _candidates(docs, width)
    small, star, lists, entries = (found.where(F.col("kind") == k) for k in range(4))
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = _verified(docs, _enough(small, entries).select("a", "b").unionByName(star))
    edges = links(first)
    members = lists.select(F.col("a").alias("set"), F.col("b").alias("e"), F.col("na").alias("n"), F.col("nb").alias("pos"))
    if not members.isEmpty():
        roots = saved(connected(edges))
        # Of a set's hubs the one that most sets have been compared with, so that many share it; a hub is its own.
        hubs = first.groupBy("hub").agg(F.count("*").alias("k"), F.first("na").alias("nx"))
        answers = first.select("hub", F.col("spoke").alias("set"), "o", "more", "less").join(hubs, "hub")
        none = F.lit(bytes(DIFF_BITS // 8))
        answers = answers.unionByName(hubs.select("hub", F.col("hub").alias("set"), F.col("nx").alias("o"), none.alias("more"), none.alias("less"), "k", "nx"))
        known = answers.groupBy("set").agg(F.max_by(F.struct("hub", "nx", "o", "more", "less"), F.struct("k", "hub")).alias("x")).select("set", "x.*")
        asked = _across(members, known, roots, width).select("a", "b").distinct()
        told = first.select(F.least("hub", "spoke").alias("a"), F.greatest("hub", "spoke").alias("b"))
        across = saved(asked.join(told, ["a", "b"], "left_anti"))
        if not across.isEmpty():
            edges = edges.unionByName(links(_verified(docs, across)))
    roots = connected(edges)
    full = member.where("n > 0").join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    # Written first, so that the join below has plain exchanges on both sides, whose hot roots Spark can split.
    best = saved(full.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    columns = ["_key", "doc_id", F.col("n").alias("n_shingles"), "set", "component_id", "root"]
    alone = member.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("root", F.lit(None).cast("long"))
    return full.join(best, "root").select(*columns).unionByName(alone.select(*columns))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with all columns, of each component only the row with the least doc_id.

    Of rows that share that doc_id the one with the least row hash stays, of exact repeats one.
    Rows with an empty set all stay.
    """
    found = near_duplicates(docs).where("n_shingles > 0")
    key, chosen, own = fresh(docs, "key", "chosen", "id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_key").alias("key"))).alias("x")
    kept_ids = found.groupBy("root").agg(first).select(F.col("x.key").alias(chosen), F.col("x.id").alias(own))
    keyed = row_key(docs, key)
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = (F.col(key) == F.col(chosen)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own))
    kept = keyed.where(~wordless).join(kept_ids, same, "left_semi")
    return kept.dropDuplicates([key, "doc_id"]).drop(key).unionByName(keyed.where(wordless).drop(key))
