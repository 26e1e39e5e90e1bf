"""Join of similar texts: Jaccard similarity of word n-grams, by a size-aware heavy-light join.

Shingles have a global order, rare ones first. Two sets of the wanted similarity share the first ``c`` of their common
shingles within a prefix of each, ``c`` longer than the number of shingles that may be missing. Light (small) sets
enumerate the subsets of ``SUBSET`` shingles of such a prefix and meet where they have a subset in common. Heavy
(large) sets scan the inverted lists of the single shingles of their prefix, and light sets of nearly their size
stand in these lists too. The boundary is the size with the least cost, counted over all sets. Shingles that only one prefix
has are left out of both.

No list is turned into all its pairs. Equal sets are one class from the start. In each list the smallest id is the pivot; every
class is compared with the pivot that it meets most often, and the links found give first components. What is left
to compare is then only pairs of different components in one list, each with a member outside the component that
most of the list belongs to. All candidates are verified with their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm import words
from linkspark.llm.graphs import components
from linkspark.llm.suffix import fixed_filter, in_filter
from linkspark.llm.tables import collected, dropped, stored, text_slices

WIDTH, PERCENT = 3, 90
#: Shingles of an enumerated subset.
SUBSET = 2
#: Cells of the table of approximate shingle frequencies, which fixes the order of shingles; it travels in so many parts. Two
#: frequencies in a ratio of two are so many levels apart.
CELLS, PARTS, LEVELS = 1 << 20, 64, 8
#: Largest number of missing shingles for which subsets are enumerated at all.
MOST_MISSING = 32
#: Cost of scanning an entry of a list, in postings.
SCAN = 1.0
#: Sizes of one list lie within this ratio.
RATIO = 0.75
#: Entries of lists that a worker holds at once.
ENTRIES = 1 << 16
#: Cells of the parities that go with every entry of a list: sets of twice as many shingles are still told apart.
SKETCH = 2048
#: Bits of the filter that tells which documents' sets a verification needs.
FILTER_BITS = 1 << 22


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and, for each text of a slice, the sorted hashes of its distinct shingles.

    A text with fewer words has its whole sequence as one shingle.
    """
    for first, _, data, offsets in text_slices(texts):
        out = []
        data = words.lower_ascii(data)
        at = words.split_words(data, offsets)
        hashes = words.span_hashes(words.running(data), at.starts, at.ends)
        windows = words.window_hashes(hashes, width)
        for a, b in zip(at.offsets[:-1].tolist(), at.offsets[1:].tolist(), strict=True):
            n = b - a
            if n >= width:
                out.append(np.unique(windows[a : b - width + 1]))
            else:
                out.append(words.window_hashes(hashes[a:b], n) if n else np.zeros(0, np.uint64))
        yield first, out


def sets_of(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The set of each text; those of one text are made once."""
    coded = texts.fill_null("").dictionary_encode()
    sets = [s for _, some in shingle_sets(coded.dictionary, width) for s in some]
    return [sets[i] for i in coded.indices.to_pylist()]


def parity(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in a power of two of cells, about as many as shingles.

    Every cell whose parity differs between two sets holds a shingle that only one of them has. With half the cells, sets
    without a common shingle would differ in few enough to pass for similar ones at 80 percent.
    """
    bits = 1 << max(6, len(s).bit_length() - 1)
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch(s: np.ndarray) -> np.ndarray:
    """The same in ``SKETCH`` cells for sets of every size, as 64-bit numbers."""
    odd = np.bincount(((s >> np.uint64(30)) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """A number of shingles that only one of the sets has, at least; the longer sketch is folded."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def missing(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of ``n`` that a similar set may lack."""
    return n - -(-n * percent // 100)


def summaries(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, set size ``n`` and 128-bit set key of every text; rows with ``part`` hold frequencies of shingles."""
    schema = "doc_id long, n long, k1 long, k2 long, part int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]
    per = CELLS // PARTS

    def rows(ids, n, k1, k2, part, counts):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, n, k1, k2, part, counts), kinds, strict=True)], names=names)

    def run(batches):
        table = np.zeros(CELLS, np.int32)
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), width):
                every = np.concatenate(sets)
                np.add.at(table, (every & np.uint64(CELLS - 1)).astype(np.int64), 1)
                n = np.array([len(s) for s in sets])
                ends = np.concatenate([[0], np.cumsum(n)])
                keys = []
                for salt in (11, 22):
                    total = np.zeros(len(every) + 1, np.uint64)
                    np.cumsum(words.mix(every + np.uint64(salt)), dtype=np.uint64, out=total[1:])
                    keys.append(words.mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64)).view(np.int64))
                empty = [None] * len(sets)
                yield rows(batch.column(0).slice(first, len(sets)).to_pylist(), n, *keys, empty, empty)
        filled = [i for i in range(PARTS) if table[i * per : (i + 1) * per].any()]
        if filled:
            none = [None] * len(filled)
            yield rows(none, none, none, none, filled, [table[i * per : (i + 1) * per].tobytes() for i in filled])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def frequencies(summary: DataFrame) -> np.ndarray:
    """The frequency table, added up in two steps; its size is fixed."""

    def add(kind):
        def run(frame):
            total = sum(np.frombuffer(x, kind).astype(np.int64) for x in frame["counts"])
            return frame[["part"]].head(1).assign(counts=[total.tobytes()])

        return run

    some = summary.where(F.col("part").isNotNull()).select("part", "counts", F.spark_partition_id().alias("_p"))
    once = some.groupBy("part", F.pmod("_p", F.lit(64)).alias("_p")).applyInPandas(add(np.int32), "part int, counts binary")
    table = np.zeros(CELLS, np.int64)
    per = CELLS // PARTS
    for r in collected(once.groupBy("part").applyInPandas(add(np.int64), "part int, counts binary")):
        table[r.part * per : (r.part + 1) * per] = np.frombuffer(bytes(r.counts), np.int64)
    return table


def prefixes(docs: DataFrame, table: np.ndarray, width: int, percent: int) -> DataFrame:
    """``doc_id``, ``n``, expected scans, parities and the rarest shingles of every set that may have similar ones.

    The number that stands for a shingle sorts by frequency on a logarithmic scale, then by hash.
    """
    level = np.floor(LEVELS * np.log2(1 + table)).astype(np.uint16)
    load = table.mean()
    shared = docs.sparkSession.sparkContext.broadcast((level, np.maximum(0, table - 2 * load - 4).astype(np.float32)))

    def run(batches):
        level, excess = shared.value
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc, s in ((ids[first + i], s) for first, sets in shingle_sets(batch.column(1), width) for i, s in enumerate(sets)):
                n = len(s)
                d = missing(n, percent)
                if n * 100 // percent == n and d < 1 or doc is None:
                    continue
                cell = (s & np.uint64(CELLS - 1)).astype(np.int64)
                order = (level[cell].astype(np.uint64) << np.uint64(55)) | (s >> np.uint64(9))
                most = min(n, d + SUBSET)
                rarest = np.sort(np.partition(order, most - 1)[:most])
                scans = float(excess[cell][np.argpartition(order, d)[: d + 1]].sum())
                out.append((doc, n, scans, parity(s), *sketch(s).tolist(), rarest.view(np.int64)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), *[pa.int64()] * len(SKETCHES), pa.list_(pa.int64())]
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "scans", "parity", *SKETCHES, "prefix"])

    schema = f"doc_id long, n long, scans double, parity binary, {', '.join(f'{c} long' for c in SKETCHES)}, prefix array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def boundary(sets: DataFrame, percent: int) -> int:
    """Largest size of a light set: the sum of postings and scanned entries over all sets is least."""
    lack = (F.col("n") - F.ceil(F.col("n") * percent / 100)).cast("int").alias("d")
    found = {r.d: r for r in sets.groupBy(lack).agg(F.count(F.lit(1)).alias("sets"), F.sum("scans").alias("scans"), F.max("n").alias("most")).where(F.col("d") <= MOST_MISSING).collect()}
    best, least, size = 0, math.inf, 0
    for x in range(MOST_MISSING + 1):
        light = sum(r.sets * math.comb(d + SUBSET, SUBSET) for d, r in found.items() if d <= x)
        heavy = sum(r.sets * (d + 1) + SCAN * r.scans for d, r in found.items() if d > x)
        if light + heavy < least:
            least, best = light + heavy, x
    for n in range(1, 100 * (MOST_MISSING + 2)):
        if missing(n, percent) <= best:
            size = n
    return size


def size_class(n: int) -> int:
    return int(math.log(n) / -math.log(RATIO) + 1e-9)


def shared_shingles(sets: DataFrame) -> DataFrame:
    """``s``: shingles that the prefixes of two sets have at least; no other can tell that sets are similar."""
    single = sets.select("node", F.explode("prefix").alias("s"))
    return single.groupBy("s").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("s")


def postings(sets: DataFrame, most_light: int, percent: int, shared: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """``key``, ``node`` and ``n``: a subset or single shingle, together with a class of sizes.

    ``pos`` is the place of the (first) shingle in the set. Only shingles that pass the filter ``shared``, and with ``wanted``
    only keys that pass that one.
    """
    sent = sets.sparkSession.sparkContext.broadcast((shared, wanted))

    def entries(held: list[tuple]) -> pa.RecordBatch:
        keys, nodes, sizes, places = zip(*held, strict=True)
        times = [len(k) for k in keys]
        columns = [np.concatenate(keys).view(np.int64), np.repeat(nodes, times), np.repeat(sizes, times), np.concatenate(places)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n", "pos"])

    def run(batches):
        shared, wanted = sent.value
        held, rows = [], 0
        for batch in batches:
            for node, n, prefix in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                p, d = np.array(prefix, np.int64).view(np.uint64), missing(n, percent)
                largest = n * 100 // percent
                place = np.flatnonzero(in_filter(shared, p))
                p = p[place]
                found, at = [], []
                if n <= most_light:
                    i, j = np.triu_indices(len(p), 1)
                    found.append(words.mix(words.mix(p[i]) + p[j]))
                    at.append(place[i])
                if largest > most_light:
                    first = int(np.searchsorted(place, d + 1))
                    found.append(words.mix(p[:first] + np.uint64(0x5851F42D4C957F2D)))
                    at.append(place[:first])
                found, at = np.concatenate(found), np.concatenate(at)
                for c in range(size_class(n), size_class(largest) + 1):
                    key = words.mix(found + np.uint64(c * 0x9E3779B97F4A7C15 % (1 << 64)))
                    keep = slice(None) if wanted is None else in_filter(wanted, key)
                    held.append((key[keep], node, n, at[keep].astype(np.int64)))
                    rows += len(held[-1][0])
                # a set may have hundreds of entries: batches are cut by these, not by sets
                if rows >= ENTRIES:
                    yield entries(held)
                    held, rows = [], 0
        if held:
            yield entries(held)

    return sets.select("node", "n", "prefix").mapInArrow(run, "key long, node long, n long, pos long")


def may_be_similar(percent: int) -> Column:
    """Of entries ``a`` and ``b`` of a list: sizes, places and parities all leave open that their sets are similar.

    At the first shingle that two sets share, what they can share is what follows it in the shorter rest.
    """
    na, nb = F.col("a.n"), F.col("b.n")
    close = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    rest = F.least(na - F.col("a.pos"), nb - F.col("b.pos"))
    differ = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in SKETCHES[1:]), F.bit_count(F.col(f"a.{SKETCHES[0]}").bitwiseXOR(F.col(f"b.{SKETCHES[0]}"))))
    return close & ((100 + percent) * rest >= percent * (na + nb)) & (100 * (na + nb - differ) >= percent * (na + nb + differ))


def told_apart(placed: DataFrame) -> DataFrame:
    """``key`` of the lists that still hold something to compare, once where several have the same members.

    Two sets that share a passage meet in a list for every shingle of it. Of lists with the same members the first one is
    kept: its shingle comes first in the order for all of them, so their places leave most open there. Members are told
    by their number and two sums of hashes, modulo two.
    """
    lists = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("m0"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("m1"),
        F.sum("pos").alias("pos"), F.min("comp").alias("low"), F.max("comp").alias("high"),
    )
    return lists.where("low < high").groupBy("c", "m0", "m1").agg(F.min(F.struct("pos", "key"))["key"].alias("key")).select("key")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` whose parities leave open that they are similar; these bounds rule out most pairs."""
    small = sets.select("node", "n", "parity")
    one = pairs.join(small.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa")), "a")
    both = one.join(small.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb")), "b")

    def run(batches):
        for batch in batches:
            a, b, na, pa_, nb, pb = (batch.column(i).to_pylist() for i in range(6))
            # common = (na + nb - different) / 2, all = (na + nb + different) / 2
            keep = [100 * (x + y - d) >= percent * (x + y + d) for x, y, d in zip(na, nb, map(least_difference, pa_, pb), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "pa", "nb", "pb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``u``, ``v`` among the stored pairs ``a``, ``b``, stored: the exact similarity of the whole sets.

    A filter of fixed size keeps the texts of most documents that are in no pair from being shuffled. The texts meet, and
    their sets are made where they do.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    bits = ends.select(spot("node").alias("s")).groupBy(F.expr("cast(s / 32 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 as int)))").alias("x"))
    needed = np.zeros(FILTER_BITS // 32, np.int64)
    for r in collected(bits):
        needed[r.w] = r.x
    shared = docs.sparkSession.sparkContext.broadcast(needed)

    def run(batches):
        needed = shared.value
        for batch in batches:
            spots = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = (needed[spots >> 5] >> (spots & 31)) & 1 == 1
            yield batch.select(["node", "text"]).filter(pa.array(keep, pa.bool_()))

    def compare(batches):
        for batch in batches:
            a, b = (sets_of(batch.column(i), width) for i in (2, 3))
            keep = []
            for x, y in zip(a, b, strict=True):
                c = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(c > 0 and 100 * c >= percent * (len(x) + len(y) - c))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("node"), spot(F.col("doc_id").cast("long")).alias("s"), "text")
    # texts take half the room of their sets, as hashes do not compress
    texts = stored(known.mapInArrow(run, "node long, text string"))
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    links = stored(both.select("a", "b", "ta", "tb").mapInArrow(compare, "u long, v long"))
    dropped(texts)
    return links


SKETCHES = [f"p{i}" for i in range(SKETCH // 64)]


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Texts are linked if ``100 * common >= percent * all`` shingles; a component has the smallest id that links reach.
    Null, empty and wordless texts have no shingles and are alone. Rows with one id are one document. A row without
    id has the component of the texts with its set, if any has an id, else null.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    summary = stored(summaries(docs, width))
    rows = summary.where(F.col("part").isNull())
    classes = stored(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node")))
    table = frequencies(summary)
    heads = rows.join(classes.where("node is not null"), ["k1", "k2", "n"]).where("doc_id = node").select("node", "n").distinct()
    found = prefixes(docs, table, width, percent).withColumnRenamed("doc_id", "node")
    sets = stored(found.join(heads, ["node", "n"]).dropDuplicates(["node", "n", "prefix"]))
    most_light = boundary(sets, percent)
    repeated = stored(shared_shingles(sets))
    shared = fixed_filter(repeated, "s")
    dropped(repeated)
    heads = postings(sets, most_light, percent, shared).groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("_last"))
    pivots = stored(heads.where("pivot < _last").drop("_last"))
    lists = stored(postings(sets, most_light, percent, shared, fixed_filter(pivots, "key")).join(pivots, "key"))
    dropped(pivots)

    met = lists.where("node != pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("c"))
    first = met.groupBy("node").agg(F.max(F.struct("c", (-F.col("pivot")).alias("p"))).alias("best")).select((-F.col("best.p")).alias("a"), F.col("node").alias("b"))
    first = stored(first)
    pairs = stored(possible(first, sets, percent))
    links = verified(pairs, docs, width, percent)
    joined = components(links)

    placed = stored(lists.join(joined, "node", "left").drop("pivot").withColumn("comp", F.coalesce("component", "node")).drop("component"))
    dropped(lists, pairs)
    few = stored(placed.join(told_apart(placed), "key"))
    dropped(placed)
    shares = few.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    main = shares.agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
    # parities only for entries of lists that still hold something to compare
    mixed = stored(few.join(main, "key").join(sets.select("node", "n", *SKETCHES), ["node", "n"]))
    dropped(few)
    a, b = mixed.where("comp != main").alias("a"), mixed.alias("b")
    once = (F.col("b.comp") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") != F.col("b.comp")) & once & may_be_similar(percent))
    rest = rest.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.join(done, ["a", "b"], "left_anti")
    pairs = stored(possible(rest, sets, percent))
    dropped(mixed, sets, first)
    more = verified(pairs, docs, width, percent)
    every = components(links.union(more))
    dropped(pairs, links, more)

    named = rows.join(classes, ["k1", "k2", "n"], "left").join(every, "node", "left")
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node")).alias("component_id"),
    )
