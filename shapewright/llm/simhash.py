"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints within BITS differing bits are linked. The 64 bits are dealt into BLOCKS blocks; two linked fingerprints agree in at
least BLOCKS - BITS of them. So the index is kept once for each mask of BLOCKS - BITS blocks, with the mask's bits moved to the
front: sorted by their rank in Gray order, fingerprints that share a masked pattern lie side by side, and similar ones near each
other. The ranks are dealt over the workers by range. A worker builds the hierarchy over its range: a node holds the bits that all
fingerprints below it share and their pattern, nodes above it what the nodes share. Every fingerprint descends from the root, adds
up differences on the way, counting each bit once at the node that fixes it, and gives up a whole group when its sum passes BITS or
when a masked bit differs. All links come from this descent, whatever the size of a group.

Only distinct fingerprints are indexed. A pattern shared by more than GROUP fingerprints is refined: its free bits are dealt into
BITS + 1 blocks, of which a linked pair has one in common. Links of a range are reduced to a forest before they leave the worker,
so what is written is linear in the fingerprints however dense a group is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import append_columns, cut, joined_by_size, place_of, quoted, slices

BITS = 4
BLOCKS = 6
WORDS = 4
SEED = 42
GROUP = 4096
"""Fingerprints that share a pattern before it is refined; over 2 ** (BITS + 1), so that a refined one has BITS + 1 free bits."""
FAN = 8
"""Fingerprints of a leaf, and children of a node."""
CHUNK = 1 << 17
"""Fingerprints of a worker's index, and those of the last pattern in it."""
FRONTIER = 1 << 19
"""Open nodes of a search at once; beyond, the search goes on with one half after the other."""
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
TOP = np.uint64(1 << 63)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's shingles; bytes are lower-cased and split as ASCII."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - WORDS + 1)
    begins = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(WORDS, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[b:e], SEED) for b, e in zip(begins, stops, strict=True)], "<u8", n)
    counts = sum(np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, n, 65536))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_array(texts: list) -> list[pa.Array]:
    return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (the key) and fp (a long with the fingerprint's bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *fingerprint_array(part.column("text").to_pylist())], names=["doc_id", "fp"])

    return df.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def deal(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks of consecutive bits, as equal as can be."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits, dtype=object), n) if len(part)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def root_masks(bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    return [sum(x) for x in combinations(deal(list(range(64)), blocks), blocks - bits)]


def finer_masks(mask: int, bits: int = BITS) -> list[int]:
    return [mask | x for x in deal([b for b in range(64) if not mask >> b & 1], bits + 1)]


def stretches(mask: int) -> list[tuple[int, int]]:
    """Lowest bit and length of each stretch of bits in the order of an index: those of the mask from the top, then the others."""
    bits = [b for b in range(63, -1, -1) if mask >> b & 1] + [b for b in range(63, -1, -1) if not mask >> b & 1]
    out = [[bits[0], 1]]
    for before, b in zip(bits, bits[1:], strict=False):
        if b == before - 1:
            out[-1] = [b, out[-1][1] + 1]
        else:
            out.append([b, 1])
    return [(low, n) for low, n in out]


def gathered(fp: np.ndarray, mask: int) -> np.ndarray:
    """Fingerprints with the mask's bits moved to the front."""
    out, at = np.zeros_like(fp), 64
    for low, n in stretches(mask):
        at -= n
        out |= ((fp >> np.uint64(low)) & np.uint64((1 << n) - 1)) << np.uint64(at)
    return out


def scattered(code: np.ndarray, mask: int) -> np.ndarray:
    """The fingerprints of which gathered() gives code."""
    out, at = np.zeros_like(code), 64
    for low, n in stretches(mask):
        at -= n
        out |= ((code >> np.uint64(at)) & np.uint64((1 << n) - 1)) << np.uint64(low)
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of a pattern in the reflected binary Gray code; the first bits of a place are the place of the first bits."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def placed(fp: np.ndarray, mask: int) -> np.ndarray:
    """Gray ranks of fingerprints in the order of a mask's index, as signed values of the same order."""
    return (gray_rank(gathered(fp, mask)) ^ TOP).view(np.int64)


def codes(place: np.ndarray) -> np.ndarray:
    """The gathered fingerprints of places."""
    rank = place.view(np.uint64) ^ TOP
    return rank ^ (rank >> np.uint64(1))


class GrayIndex:
    """Hierarchical index of codes in Gray order: levels of nodes with the bits and the pattern that all below a node share."""

    def __init__(self, ordered: np.ndarray):
        self.codes = ordered
        every, any_ = ordered, ordered
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from leaves up: shared bits, pattern
        while len(every) > 1 or not self.levels:
            starts = np.arange(0, len(every), FAN)
            every, any_ = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(any_, starts)
            shared = ~(every ^ any_)
            self.levels.append((shared, every & shared))

    def search(self, queries: np.ndarray, bits: int = BITS, exact: np.uint64 = np.uint64(0), after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs, in parts, of a query's number and the place of a code that differs in at most so many bits, and in none of exact.

        after: for each query, the place beyond which codes count.
        """
        n = len(queries)
        top = len(self.levels)
        stack = [(top, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint8))] if n and len(self.codes) else []
        while stack:
            level, q, node, counted, acc = stack.pop()
            if len(q) > FRONTIER // FAN:
                half = len(q) // 2
                stack += [(level, q[s], node[s], counted[s], acc[s]) for s in (slice(half, None), slice(half))]
                continue
            level -= 1
            if level < top - 1:
                below = len(self.levels[level][0]) if level >= 0 else len(self.codes)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, counted, acc = np.repeat(q, FAN), np.repeat(counted, FAN), np.repeat(acc, FAN)
                inside = node < below
                if after is not None:
                    inside &= (node + 1) * FAN ** (level + 1) - 1 > after[q]
                q, node, counted, acc = q[inside], node[inside], counted[inside], acc[inside]
            shared, pattern = (self.levels[level][0][node], self.levels[level][1][node]) if level >= 0 else (ALL, self.codes[node])
            apart = (queries[q] ^ pattern) & shared & ~counted
            acc = acc + np.bitwise_count(apart)
            near = (acc <= bits) & ((apart & exact) == 0)
            if not near.any():
                continue
            if level < 0:
                yield q[near], node[near]
            else:
                stack.append((level, q[near], node[near], shared[near], acc[near]))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each of n members' groups, as linked by pairs that come in parts."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            for x in (label[a], label[b], a, b):
                np.minimum.at(label, x, low)
            label = label[label]
            if (label == before).all():
                break
    return label


def gathered_parts(parts: Iterator[tuple[np.ndarray, np.ndarray]], size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= size:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, n = [], 0
    if held:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def linked(places: np.ndarray, mask: int, bits: int = BITS) -> np.ndarray:
    """The least member of each member's part, of members in the order of a mask's index that link where they share its pattern."""
    ordered = codes(places)
    kept = np.uint64(mask.bit_count())
    exact = ALL << (np.uint64(64) - kept) if kept else np.uint64(0)
    index = GrayIndex(ordered)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(ordered), 4096):
            for q, found in index.search(ordered[at : at + 4096], bits, exact, np.arange(at, min(len(ordered), at + 4096))):
                yield q + at, found

    return forest(len(ordered), gathered_parts(pairs()))


def links(nodes: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """a and b: fingerprints of nodes (distinct, column fp) linked, as forests of the ranges of each mask's index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.array([], np.int64)] * 2

        def out(masks: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
            for m in np.unique(masks):
                own, mask = places[masks == m], int(m) % (1 << 64)
                root = linked(own, mask, bits)
                at = np.flatnonzero(root != np.arange(len(root)))
                fp = lambda i: pa.array(scattered(codes(own[i]), mask).view(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([fp(at), fp(root[at])], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) > chunk:
                head = held[1] >> (64 - (int(held[0][-1]) % (1 << 64)).bit_count())
                last = np.flatnonzero((held[0] != held[0][-1]) | (head != head[-1]))
                if len(last):
                    n = last[-1] + 1
                    yield from out(*[h[:n] for h in held])
                    held = [h[n:] for h in held]
        if len(held[0]):
            yield from out(*held)

    roots = root_masks(bits)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mask and place of each fingerprint in the index of each mask."""
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for m in roots:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), signed(m), np.int64)), pa.array(placed(fp, m))], names=["mask", "place"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same for each mask below a row's own."""
        for batch in batches:
            masks, places = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for m in np.unique(masks):
                mask = int(m) % (1 << 64)
                fp = scattered(codes(places[masks == m]), mask)
                for x in finer_masks(mask, bits):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), signed(x), np.int64)), pa.array(placed(fp, x))], names=["mask", "place"])

    masked, found = nodes.select("fp").mapInArrow(begin, "mask long, place long"), None
    while True:
        keyed = masked.select("mask", F.expr("shiftright(place, cast(64 - bit_count(mask) AS int))").alias("head"), "place")
        large = cut(keyed.groupBy("mask", "head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("mask", "head"))
        over = bool(large.take(1))
        small = keyed.join(large, ["mask", "head"], "left_anti") if over else keyed
        new = small.repartitionByRange("mask", "head").sortWithinPartitions("mask", "place").select("mask", "place").mapInArrow(run, "a long, b long")
        found = new if found is None else found.unionAll(new)
        if not over:
            return found
        masked = cut(keyed.join(large, ["mask", "head"], "left_semi").select("mask", "place").mapInArrow(refine, "mask long, place long"))


def rooted_components(df: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """doc_id (the key), fp, root (the least fingerprint of the component, as a long) and component_id for each row of df."""
    each = cut(fingerprints(df, key, text))
    nodes = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    star = components(links(nodes.select("fp"), bits))
    whole = star.unionAll(star.select(F.col("root").alias("node"), "root").distinct())
    rooted = nodes.select("fp", "least").join(whole.withColumnRenamed("node", "fp"), "fp")
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = joined_by_size(rooted.select("fp", "root"), least, "root", "members", rooted.count())
    of = nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return joined_by_size(each, cut(of), "fp", "n", each.count()).select("doc_id", "fp", "root", "component_id")


def near_components(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id (the key), fp and component_id, the smallest key that links reach from the row, for each row of df.

    key: a column of integers. Texts without words, null and empty ones, have fingerprint zero, which links like any other. Rows
    with equal keys are rows like others; a null key is no component_id unless a component has no other. Other columns are not read,
    whatever their names. An empty table gives an empty one. Texts are read once and not moved; what is moved are fingerprints.
    """
    return rooted_components(df, key, text, bits).select("doc_id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df of each component, that of the smallest key, with the columns of df, whatever their names.

    A null key comes after all others. Of several rows with the same key, or without one, the one of the smallest fingerprint (as a
    signed value) in the component stays, and of those that are equal in that too, any one. An empty table gives an empty one.
    """
    own, names = f"c{place_of(df, key)}", df.columns
    rows = df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("id", F.col(own).cast("long"))
    marked = cut(rooted_components(df, key, text, BITS).select(F.col("doc_id").alias("id"), "fp", "root"))
    total = marked.count()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("w")
    winners = cut(marked.groupBy("root").agg(first).select("w.id", "w.fp"))
    known = cut(marked.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("size")))
    one = known.where("size = 1").join(winners.select("id"), "id", "left_anti")
    several = known.where("size > 1")
    once = joined_by_size(rows.where("id IS NOT NULL"), one.unionAll(several), "id", "size", total, "left_anti")
    if not several.take(1) and not marked.where("id IS NULL").take(1):
        return once.drop("id").toDF(*names)
    # such a key doesn't tell which of its rows to keep; their fingerprints, taken again, do
    vague = rows.where("id IS NULL").unionByName(joined_by_size(rows, several, "id", "size", total))
    again = append_columns(vague, f"c{place_of(df, text)}", lambda: fingerprint_array, [T.StructField("fp", T.LongType())])
    name = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "fp").alias("own")
    sizes = marked.groupBy(name).agg(F.count(F.lit(1)).alias("size"))
    chosen = joined_by_size(again.withColumn("own", name), sizes.join(winners.select(name), "own", "left_semi"), "own", "size", total).dropDuplicates(["own"])
    return once.drop("id").unionByName(chosen.drop("own", "fp", "id")).toDF(*names)


def near_documents(docs: DataFrame) -> DataFrame:
    """op8: fingerprint and component of every document."""
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
