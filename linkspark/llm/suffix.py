"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Most text repeats
nowhere, so it never reaches a suffix array: every such string has one anchor, the ``GRAM`` bytes with the least hash
in it, and equal strings have equal anchors. Some anchors, by their hash, divide a text into blocks of strings;
of equal blocks all but the one in the smallest document are lost whole. Anchors that two different blocks have are
shared; around each lies a context, the strings that have it as their anchor. Equal contexts are one class, owned by
its smallest document, and every other document loses them whole. What remains is to compare the different contexts of
a shared anchor: they are dealt over shards, each shard sorts the suffixes of its contexts (Larsson-Sadakane refinement,
which sorts only groups that are still tied), finds common prefixes with Kasai's scan, and so the smallest document of each
string. Contexts of one anchor that are too many for a shard lie in several; their strings are then merged by binary
search in sorted ranges. Whole texts and blocks are compared by cryptographic digests of 128 bits, contexts by two 64-bit
hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm import words
from linkspark.llm.tables import collected, dropped, stored, text_slices

LENGTH, GRAM = 50, 28
#: Anchors of a block, on average.
BLOCK = 16
#: Depth to which suffixes are sorted: the first power of two from ``LENGTH`` on.
DEPTH = 64
#: Contexts of a shard, about, and strings of a merged range.
SHARD, RANGE = 20_000, 500_000
#: Contexts of one anchor above which they are dealt over several shards.
SPLIT = 5_000
#: Least and largest number of bits of the filters that tell which anchors are shared and which texts lose bytes; the bits of a
#: value that give its second place begin here.
FILTER_BITS, MOST_FILTER_BITS, SECOND = 1 << 26, 1 << 29, 26
#: Anchors that a worker packs together, and those of a group, about.
PART = 1 << 19
#: String starts handled at once.
CHUNK = 4 << 20


_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes at every place; they only choose anchors, what is removed is compared by other ones."""
    count = max(0, len(data) - GRAM + 1)
    if not count:
        return np.zeros(0, np.uint64)
    eights = np.empty(len(data) - 7, np.uint64)
    for i in range(8):
        part = np.frombuffer(data, np.uint64, (len(data) - i) // 8, i)
        eights[i::8] = part
    eights *= _FACTORS[0]
    eights ^= eights >> np.uint64(32)
    out = eights[:count] * _FACTORS[1]
    for k, at in enumerate([*range(8, GRAM - 8, 8), GRAM - 8], 2):
        out += eights[at : at + count] * _FACTORS[k]
    return words.mix(out)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` following values, at every place where they fit."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, place of the context's first byte, number of its strings, and hash of the anchor, of every anchor."""
    sizes = np.diff(offsets)
    strings = np.maximum(0, sizes - LENGTH + 1)
    grams = gram_hashes(data)
    width = LENGTH - GRAM + 1
    found = []
    low = np.uint64((1 << 24) - 1)
    for begin in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        end = min(begin + CHUNK, len(data) - LENGTH + 1)
        part = grams[begin : end + width - 1]
        least = sliding_least((part & ~low) | np.arange(len(part), dtype=np.uint64), width)
        found.append((least & low).astype(np.int64) + begin)
    if not found or not strings.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    text = np.repeat(np.arange(len(sizes)), strings)
    start = np.arange(len(text)) - np.repeat(np.cumsum(strings) - strings, strings) + np.repeat(offsets[:-1], strings)
    place = np.concatenate(found)[start]
    first = np.ones(len(place), bool)
    first[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return text[at], start[at], np.diff(np.append(at, len(place))), grams[place[at]]


def digest_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers of the cryptographic digest of each span."""
    content = data.tobytes()
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    return np.frombuffer(b"".join([hashlib.blake2b(content[a:b], digest_size=16).digest() for a, b in spans]), np.int64).reshape(-1, 2)


def blocks_of(text: np.ndarray, start: np.ndarray, strings: np.ndarray, h: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """First anchor and digest of each block of anchors that follow each other, and the block of each anchor."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    new = (h >> np.uint64(40)) % np.uint64(BLOCK) == 0
    new[0] = True
    new[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    return first, digest_pairs(data, start[first], start[last] + strings[last] + LENGTH - 1), np.cumsum(new) - 1


def rows_of(batch: pa.RecordBatch):
    """``(first row, bytes, offsets)`` of slices of the texts in the second column."""
    for first, _, data, offsets in text_slices(batch.column(1)):
        yield first, data, offsets


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digest_pairs(data, offsets[:-1], offsets[1:])[:, 0])


def context_hashes(data: np.ndarray, start: np.ndarray, strings: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each context; together with its anchor's hash it names a class."""
    return words.mix(words.short_hashes(data, start, strings + LENGTH - 1, 2 * LENGTH - GRAM) + h)


def summaries(docs: DataFrame) -> DataFrame:
    """Size, two hashes and SHA-256 of every text."""

    def run(batches):
        for batch in batches:
            for first, data, offsets in rows_of(batch):
                n = len(offsets) - 1
                keys = digest_pairs(data, offsets[:-1], offsets[1:])
                sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [batch.column(0).slice(first, n), pa.array(np.diff(offsets)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sha)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "t1", "t2", "sha"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, t1 long, t2 long, sha binary")


def filter_bits(n: int) -> int:
    """Bits of a filter of ``n`` values: 8 to 16 for each, so that few other values pass, between fixed bounds."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (8 * n).bit_length()))


def fixed_filter(values: DataFrame, column: str, n: int | None = None) -> np.ndarray:
    """Two bits for every value in a table that grows with their number ``n``: never wrong about a value that is there."""
    size = filter_bits(values.count() if n is None else n)
    # both places of a value, by different bits of it
    places = [F.col(column), F.shiftrightunsigned(column, SECOND)]
    spots = values.select(F.explode(F.array(*[p.bitwiseAND(F.lit(size - 1)) for p in places])).alias("s"))
    spots = spots.select(F.shiftright("s", 16).cast("int").alias("part"), F.col("s").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("s"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, np.uint8)
        bits[frame["s"].to_numpy()] = 1
        return pd.DataFrame({"part": frame["part"].head(1), "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    for r in collected(spots.groupBy("part").applyInPandas(pack, "part int, bits binary")):
        out[r.part * 8192 : (r.part + 1) * 8192] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    values = values.view(np.uint64)
    keep = _set(bits, values)
    some = np.flatnonzero(keep)
    keep[some] = _set(bits, values[some] >> np.uint64(SECOND))
    return keep


def _set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    spot = (values & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1


def least_and_greatest(h: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each ``h``, in ascending order: itself, its least and its greatest ``s``."""
    order = np.argsort(h)
    h, s = h[order], s[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(head):
        return h, s, s
    return h[head], np.minimum.reduceat(s, head), np.maximum.reduceat(s, head)


def turned(h: np.ndarray, bits: int) -> np.ndarray:
    """Turn 64-bit numbers left. Anchors are least hashes, of which only the low 24 bits are spread evenly."""
    return h << np.uint64(bits) | h >> np.uint64(64 - bits)


def anchor_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Anchors ``h``, turned, and blocks ``s`` they lie in, many in a row; ``part`` is a range of anchors.

    Of the blocks that one anchor has in a portion of text only the least and the greatest go on.
    """

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, least, greatest = least_and_greatest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        two = least != greatest
        edges = -(-(np.arange(parts + 1, dtype=object) << 24) // parts)
        edges = np.array(edges[:-1].astype(np.uint64)) << np.uint64(40)
        rows = [([*np.searchsorted(x, edges), len(x)], x, y) for x, y in ((h, least), (h[two], greatest[two]))]
        some = [i for i in range(parts) if rows[0][0][i] < rows[0][0][i + 1]]
        hs, ss = ([b"".join(r[k][r[0][i] : r[0][i + 1]].tobytes() for r in rows) for i in some] for k in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(hs, pa.binary()), pa.array(ss, pa.binary())], names=["part", "h", "s"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, data, offsets in rows_of(batch):
                text, start, strings, h = anchors(data, offsets)
                _, s, block = blocks_of(text, start, strings, h, data)
                held.append((turned(h, 40), s[block, 0]))
                n += len(h)
                if n >= PART:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return docs.mapInArrow(run, "part int, h binary, s binary")


def shared_anchors(docs: DataFrame, n_bytes: int) -> DataFrame:
    """``h``: anchors that lie in two different blocks at least. The number of groups grows with the bytes of text."""

    def several(frame: pd.DataFrame) -> pd.DataFrame:
        h, s = (np.frombuffer(b"".join(frame[x]), kind) for x, kind in (("h", np.uint64), ("s", np.int64)))
        h, least, greatest = least_and_greatest(h, s)
        return pd.DataFrame({"h": turned(h[least != greatest], 24).view(np.int64)})

    # strings of random text have two anchors in every LENGTH - GRAM + 2 bytes
    parts = min(1 << 24, max(1, 2 * n_bytes // (LENGTH - GRAM + 2) // PART))
    return anchor_blocks(docs, parts).groupBy("part").applyInPandas(several, "h long")


def blocks(docs: DataFrame) -> DataFrame:
    """Block (``s``, ``s2``), document, text hash, first byte ``low`` and number of ``strings`` of every block."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in rows_of(batch):
                text, start, strings, h = anchors(data, offsets)
                at, s, _ = blocks_of(text, start, strings, h, data)
                size = np.add.reduceat(strings, at) if len(at) else strings
                arrays = [
                    pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(ids[first + text[at]].astype(np.int64)),
                    pa.array(text_keys(data, offsets)[text[at]]), pa.array(start[at] - offsets[text[at]]), pa.array(size),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["s", "s2", "doc_id", "t1", "low", "strings"])

    return docs.mapInArrow(run, "s long, s2 long, doc_id long, t1 long, low long, strings long")


def owner_keys(h: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return words.mix(h.view(np.uint64) + words.mix(doc_id.view(np.uint64)))


def shared_contexts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Anchor ``h``, class ``c``, document, text hash, first byte ``low`` and ``strings`` of contexts whose anchor passes the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(fixed_filter(shared, "h"))

    def run(batches):
        bits = sent.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in rows_of(batch):
                text, start, strings, h = (x[keep] for keep, x in _passing(bits, anchors(data, offsets)))
                c = context_hashes(data, start, strings, h)
                arrays = [
                    pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids[first + text].astype(np.int64)),
                    pa.array(text_keys(data, offsets)[text]), pa.array(start - offsets[text]), pa.array(strings),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "c", "doc_id", "t1", "low", "strings"])

    return docs.mapInArrow(run, "h long, c long, doc_id long, t1 long, low long, strings long")


def _passing(bits: np.ndarray, found: tuple[np.ndarray, ...]):
    keep = in_filter(bits, found[-1])
    return [(keep, x) for x in found]


def context_bytes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``h``, ``c``, ``owner``, ``strings`` and bytes of each of the ``classes`` (``h``, ``c``, ``owner``)."""

    def keys(batches):
        for batch in batches:
            h, owner = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(owner_keys(h, owner).view(np.int64))], names=["k"])

    sent = docs.sparkSession.sparkContext.broadcast(fixed_filter(classes.select("h", "owner").mapInArrow(keys, "k long"), "k", classes.count()))

    def run(batches):
        bits = sent.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in rows_of(batch):
                text, start, strings, h = anchors(data, offsets)
                owner = ids[first + text].astype(np.int64)
                keep = in_filter(bits, owner_keys(h, owner))
                start, strings, h, owner = start[keep], strings[keep], h[keep], owner[keep]
                # few are left: only their bytes are hashed
                c = context_hashes(data, start, strings, h)
                content, end = data.tobytes(), start + strings + LENGTH - 1
                parts = pa.array([content[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())
                arrays = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(owner), pa.array(strings), parts]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "c", "owner", "strings", "bytes"])

    found = docs.mapInArrow(run, "h long, c long, owner long, strings long, bytes binary")
    return found.join(classes, ["h", "c", "owner"]).dropDuplicates(["h", "c", "owner"])


def suffix_array(data: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes at least, and the rank of each; past the end lie zeros.

    The first sort is by eight bytes. Each refinement doubles the depth and sorts the groups that are still tied by
    the rank that lies one depth further on; a group's rank is the place of its first suffix.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, n))
    rank = np.zeros(n + 1, np.int64)  # the last entry: past the end, before all
    rank[order] = np.repeat(heads, sizes) + 1
    done = 8
    while done < depth:
        tied = np.repeat(sizes > 1, sizes)
        places = np.flatnonzero(tied)
        if not len(places):
            break
        suffixes = order[places]
        group, further = rank[suffixes], rank[np.minimum(suffixes + done, n)]
        by = np.lexsort((further, group))
        suffixes, group, further = suffixes[by], group[by], further[by]
        order[places] = suffixes
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (further[1:] != further[:-1])])
        head = np.zeros(n, bool)
        head[heads] = True
        head[places[new]] = True
        heads = np.flatnonzero(head)
        sizes = np.diff(np.append(heads, n))
        rank[order] = np.repeat(heads, sizes) + 1
        done *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int = DEPTH) -> np.ndarray:
    """For each place of ``order``: bytes in common with the suffix before it, ``most`` at most, by Kasai's scan.

    Going from one suffix of a context to the next loses at most one byte of the common prefix; all contexts
    are walked at the same time. That does not hold after suffixes that are equal to the depth of the sort, as these are
    in no order; there the count begins anew. Only the first ``counts`` suffixes of each context are measured.
    """
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(place > 0, order[place - 1], -1)
    padded = np.concatenate([data, np.zeros(most + 1, np.uint8)])
    out = np.zeros(n, np.int64)
    have = np.zeros(len(starts), np.int64)
    for step in range(int(counts.max()) if len(counts) else 0):
        live = np.flatnonzero(counts > step)
        i = starts[live] + step
        j = before[i]
        h = np.where(have[live] < most, np.maximum(have[live] - 1, 0), 0)
        growing = np.flatnonzero(j >= 0)
        h[j < 0] = 0
        while len(growing):
            a, b = i[growing] + h[growing], j[growing] + h[growing]
            same = (h[growing] < most) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
            growing = growing[same]
            h[growing] += 1
        have[live] = h
        out[place[i]] = h
    return out


def string_owners(contents: list[bytes], counts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest document of each string of the contexts of a shard.

    Returns, for every string: its context, its number there, its first byte in the joined contexts, and the owner.
    """
    sizes = np.array([len(x) for x in contents])
    data = np.frombuffer(b"".join(contents), np.uint8)
    starts = np.cumsum(sizes) - sizes
    order, _ = suffix_array(data)
    prefix = common_prefixes(data, order, starts, counts)
    context = np.repeat(np.arange(len(contents)), sizes)
    number = np.arange(len(data)) - starts[context]
    real = number < counts[context]
    owner = np.where(real, docs[context], np.iinfo(np.int64).max)
    # suffixes that are too short to be strings were not measured and part no run of equal strings by themselves
    kept = order[real[order]]
    joined = prefix[real[order]] >= LENGTH
    if len(kept):
        joined[0] = False
    # a short suffix between two equal strings: compare the strings themselves
    gap = np.flatnonzero(np.diff(np.flatnonzero(real[order])) > 1) + 1
    if len(gap):
        a, b = kept[gap], kept[gap - 1]
        joined[gap] = (data[a[:, None] + np.arange(LENGTH)] == data[b[:, None] + np.arange(LENGTH)]).all(axis=1)
    heads = np.flatnonzero(~joined)
    least = np.minimum.reduceat(owner[kept], heads) if len(heads) else np.zeros(0, np.int64)
    best = np.repeat(least, np.diff(np.append(heads, len(kept))))
    return context[kept], number[kept], kept, best


def compared(contexts: DataFrame) -> DataFrame:
    """``h``, ``c`` and ``mask``: the strings of each class that a class of the same anchor with a smaller owner has."""
    n = contexts.count()
    shards = max(1, -(-n // SHARD))
    many = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("h", F.ceil(F.col("n") / SPLIT).alias("subs"))
    dealt = contexts.join(many, "h", "left").withColumn("shard", F.pmod("h", F.lit(shards)))
    sub = F.when(F.col("subs").isNotNull(), F.pmod(F.xxhash64("h", "c"), F.col("subs")) + 1).otherwise(F.lit(0).cast("long"))
    # several anchors may be split; the parts of each go to shards of their own
    dealt = dealt.withColumn("sub", sub).withColumn("own", F.when(F.col("sub") > 0, F.col("h")).otherwise(F.col("shard")))

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        contents = [bytes(x) for x in frame["bytes"]]
        owners = frame["owner"].to_numpy()
        context, number, at, best = string_owners(contents, frame["strings"].to_numpy(), owners)
        if frame["sub"].iloc[0]:
            data = np.frombuffer(b"".join(contents), np.uint8)
            k1, k2 = (words.short_hashes(data, at, np.full(len(at), LENGTH), LENGTH, seed).view(np.int64) for seed in (1, 2))
            out = pd.DataFrame({"h": frame["h"].to_numpy()[context], "c": frame["c"].to_numpy()[context], "mask": np.int64(1) << number, "owner": owners[context], "best": best, "k1": k1, "k2": k2})
            return out
        hit = best < owners[context]
        mask = np.zeros(len(contents), np.int64)
        np.bitwise_or.at(mask, context[hit], np.int64(1) << number[hit])
        some = mask != 0
        blank = np.zeros(int(some.sum()), np.int64)
        return pd.DataFrame({"h": frame["h"].to_numpy()[some], "c": frame["c"].to_numpy()[some], "mask": mask[some], "owner": blank, "best": blank, "k1": blank, "k2": blank}).assign(k1=None, k2=None)

    schema = "h long, c long, mask long, owner long, best long, k1 long, k2 long"
    found = stored(dealt.groupBy("own", "sub").applyInPandas(shard, schema))
    whole = found.where("k1 is null").select("h", "c", "mask")
    apart = found.where("k1 is not null")
    ranges = max(1, -(-apart.count() // RANGE))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        """Smallest owner over all shards: binary search among the sorted strings of the range."""
        by = np.lexsort((frame["best"], frame["k2"], frame["k1"]))
        k1, k2, best = (frame[x].to_numpy()[by] for x in ("k1", "k2", "best"))
        head = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        keys = np.rec.fromarrays([k1[head], k2[head]])
        least = best[head]
        place = np.searchsorted(keys, np.rec.fromarrays([frame["k1"].to_numpy(), frame["k2"].to_numpy()]))
        hit = least[place] < frame["owner"].to_numpy()
        return frame.loc[hit, ["h", "c", "mask"]]

    key_range = F.least(F.floor((F.col("k1") / float(1 << 64) + 0.5) * ranges), F.lit(ranges - 1))
    merged = apart.withColumn("range", key_range).groupBy("range").applyInPandas(merge, "h long, c long, mask long")
    return whole.union(merged.groupBy("h", "c").agg(F.bit_or("mask").alias("mask")))


def cut(data: bytes, low: np.ndarray, mask: np.ndarray, run: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed, and what is kept.

    A mark has strings from ``low`` on: those of a mask's bits, or so many as a run has.
    """
    whole = run > 0
    mark, bit = np.nonzero((mask[:, None] >> np.arange(LENGTH - GRAM + 1)) & 1)
    begins = np.concatenate([low[whole], low[mark] + bit])
    ends = np.concatenate([low[whole] + run[whole] - 1, low[mark] + bit]) + LENGTH
    n = len(data) + 1
    gone = np.cumsum(np.bincount(begins, minlength=n) - np.bincount(ends, minlength=n))[:-1] > 0
    spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row of ``docs`` (``doc_id``, ``text``).

    A null text is empty. A row without id loses nothing and counts for no other. Rows with one id do not count for
    each other. What is kept is a digest here; :func:`kept_bytes` has the bytes.
    """
    return _finished(docs, lambda data: hashlib.sha256(data).hexdigest(), "kept_sha256 string", F.lower(F.hex("sha")), hashlib.sha256(b"").hexdigest())


def kept_bytes(docs: DataFrame) -> DataFrame:
    """As :func:`removed`, with ``kept``, the bytes that are left, or null where nothing was removed."""
    return _finished(docs, lambda data: data, "kept binary", None, b"")


def marked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries of all rows with ``copy`` (a smaller document has the whole text), and the marks of other rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where(F.col("doc_id").isNotNull())
    summary = stored(summaries(docs))
    # only texts that several rows have; all others are in the summary alone
    heads = stored(summary.groupBy("t1", "t2", "n_bytes").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").drop("last"))
    rows = summary.join(heads, ["t1", "t2", "n_bytes"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False)) & (F.col("n_bytes") >= LENGTH))
    every = stored(blocks(known))
    first = every.groupBy("s", "s2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("s", "s2", "owner")
    # each table goes as soon as the next ones are there, and the marks are made in steps: the disk holds one step's files at a time
    lost = stored(every.join(first, ["s", "s2"]).where("doc_id > owner").select("doc_id", "t1", "low", F.lit(0).cast("long").alias("mask"), F.col("strings").alias("run")))
    dropped(every)
    n_bytes = summary.agg(F.sum("n_bytes")).first()[0] or 0
    shared = stored(shared_anchors(known, n_bytes))
    found = stored(shared_contexts(known, shared))
    dropped(shared)
    classes = stored(found.groupBy("h", "c").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")))
    several = classes.groupBy("h").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a < b").select("h")
    apart = stored(classes.join(several, "h").select("h", "c", "owner"))
    contexts = stored(context_bytes(known, apart))
    dropped(apart)
    masks = stored(compared(contexts))
    dropped(contexts)
    own = stored(classes.join(masks, ["h", "c"], "left").where((F.col("owner") < F.col("last")) | F.col("mask").isNotNull()).select("h", "c", "owner", "mask"))
    dropped(classes, masks)
    whole = F.expr("shiftleft(1L, cast(strings as int)) - 1")
    marks = found.select("h", "c", "doc_id", "t1", "low", "strings").join(own, ["h", "c"])
    marks = marks.withColumn("mask", F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(F.coalesce("mask", F.lit(0).cast("long")))).where("mask != 0")
    marks = stored(marks.select("doc_id", "t1", "low", "mask", F.lit(0).cast("long").alias("run")))
    dropped(found, own)
    copies = rows.where("copy").select("doc_id", "t1").distinct()
    lists = marks.union(lost).join(copies, ["doc_id", "t1"], "left_anti").groupBy("doc_id", "t1").agg(F.collect_set(F.struct("low", "mask", "run")).alias("marks"))
    lists = stored(lists)
    dropped(marks, lost)
    return rows, lists


def _finished(docs: DataFrame, digest, kind: str, whole: Column | None, nothing: str | bytes) -> DataFrame:
    rows, lists = marked(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fixed_filter(lists, "t1"))
    name, text_kind = kind.split()[0], kind.endswith("string")

    def texts(batches):
        bits = sent.value
        for batch in batches:
            for first, data, offsets in rows_of(batch):
                keys = text_keys(data, offsets)
                keep = np.flatnonzero(in_filter(bits, keys))
                content = [data[offsets[i] : offsets[i + 1]].tobytes() for i in keep.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + keep)), pa.array(keys[keep]), pa.array(content, pa.binary())], names=["doc_id", "t1", "bytes"])

    def finish(batches):
        for batch in batches:
            ids, t1, content, marks = (batch.column(i) for i in range(4))
            low, mask, run = (marks.flatten().field(i).to_numpy() for i in range(3))
            at = marks.offsets.to_numpy() - marks.offsets[0].as_py()
            spans = [slice(a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            out = [cut(b, low[x], mask[x], run[x]) for b, x in zip(content.to_pylist(), spans, strict=True)]
            n, runs, left = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, t1, pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array([digest(x) for x in left], pa.string() if text_kind else pa.binary())], names=["doc_id", "t1", "n_removed", "n_spans", name])

    some = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(texts, "doc_id long, t1 long, bytes binary")
    done = some.join(lists, ["doc_id", "t1"]).select("doc_id", "t1", "bytes", "marks").mapInArrow(finish, f"doc_id long, t1 long, n_removed long, n_spans long, {kind}").dropDuplicates(["doc_id", "t1"])
    out = rows.join(done, ["doc_id", "t1"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.col(name) if whole is None else F.coalesce(F.col(name), whole)).alias(name),
    )
