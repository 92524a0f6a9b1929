"""SimHash near-duplicates: a vantage-point tree over fingerprints, cut into shards.

A vantage point splits fingerprints into those within a distance and those beyond. By the triangle
inequality a fingerprint further than ``distance + bits`` from the point has no partner inside. So every
fingerprint lives in one shard and visits only the inner shards whose boundary it is close to; inside a
shard the tree goes on in memory. All pairs within the bit distance are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from augspark.llm.arrays import byte_table, lower_ascii, text_blocks
from augspark.llm.components import connected_components, forest
from augspark.session import cut_lineage

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
# Fingerprints that the top of the tree is fitted on, and fingerprints wanted in a shard
SAMPLE, SHARD = 4096, 100_000
# At the end of the tree all pairs of a leaf's home rows and its visitors are compared
LEAF = 64


def fingerprints(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit SimHash of every text of a block: a bit is set if over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    n = len(starts)
    out = np.zeros(n, np.uint64)
    space = byte_table((0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))[buf]
    # one space after every word
    after_word = space & np.concatenate([[False], ~space[:-1]])
    kept = ~space | after_word
    place = np.cumsum(kept)
    text_end = place[ends] - after_word[ends].astype(np.int64) if n else place
    plain = lower_ascii(buf)[kept]
    gap = after_word[kept]
    plain[gap] = 0x20
    last = np.flatnonzero(gap)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    text = np.searchsorted(text_end, first, "right")
    count = np.bincount(text, minlength=n)[:n]
    begin = np.cumsum(count) - count
    # shingles of a text: one less than its words for each further word of a shingle, one at least
    size = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    stop = np.minimum(at + words - 1, np.repeat(begin + count - 1, size))
    view = memoryview(plain)
    hashes = np.fromiter(
        (xxh64_intdigest(view[a:b], SEED) for a, b in zip(first[at].tolist(), last[stop].tolist(), strict=True)), np.uint64, len(at)
    )
    full = np.flatnonzero(size)
    if len(full):
        cuts = (np.cumsum(size) - size)[full]
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), cuts)
            out[full] |= (2 * ones > size[full].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number. Null texts count as empty; without words it is 0."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, starts, ends in text_blocks(batch.column(1)):
                fp = fingerprints(buf, starts, ends, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(fp)], names=[key, "fp"])

    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {id_type}, fp bigint")


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def choose_point(sample: np.ndarray, bits: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and distance that split the sample well: few rows near the boundary, both sides filled."""
    best, cost = None, 2.0
    for vp in rng.choice(sample, min(12, len(sample)), replace=False):
        d = np.sort(distances(sample, vp))
        for share in (0.35, 0.5, 0.65):
            t = int(d[int(share * (len(d) - 1))])
            inner = np.searchsorted(d, t, "right") / len(d)
            visits = (np.searchsorted(d, t + bits, "right") - np.searchsorted(d, t, "right")) / len(d)
            # the larger of: inner shard with its visitors, outer shard
            if (worst := max(inner + visits, 1 - inner)) < cost:
                best, cost = (vp, t), worst
    return best if cost < 0.95 else None


def build_top(sample: np.ndarray, depth: int, bits: int, rng: np.random.Generator) -> tuple | None:
    """The top of the tree as nested (point, distance, inner, outer); None is a shard."""
    if depth == 0 or len(sample) < 16:
        return None
    chosen = choose_point(sample, bits, rng)
    if chosen is None:
        return None
    vp, t = chosen
    inside = distances(sample, vp) <= t
    return vp, t, build_top(sample[inside], depth - 1, bits, rng), build_top(sample[~inside], depth - 1, bits, rng)


def route(tree: tuple | None, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is_home) of every fingerprint: its home, and the shards it must visit."""
    rows, shards, homes = [], [], []
    count = 0

    def go(node, row, home):
        nonlocal count
        if node is None:
            rows.append(row)
            shards.append(np.full(len(row), count))
            homes.append(home)
            count += 1
            return
        vp, t, inner, outer = node
        d = distances(fps[row], vp)
        # a home row beyond the boundary visits the inner side; one inside need not visit the outer side,
        # as its partners there come to it
        goes_in = d - np.where((d <= t) & home, 0, bits) <= t
        goes_out = np.where(home, d > t, d + bits > t)
        go(inner, row[goes_in], (home & (d <= t))[goes_in])
        go(outer, row[goes_out], home[goes_out])

    go(tree, np.arange(len(fps)), np.ones(len(fps), bool))
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


def close_pairs(home: np.ndarray, visit: np.ndarray, bits: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs within the bit distance, of two home rows or of a visitor and a home row."""
    stack = [(home, visit)]
    while stack:
        home, visit = stack.pop()
        if not len(home):
            continue
        chosen = None
        if len(home) > LEAF:
            sample = home if len(home) <= 512 else rng.choice(home, 512, replace=False)
            chosen = choose_point(sample, bits, rng)
        if chosen is None:
            yield from _all_close(home, visit, bits)
            continue
        vp, t = chosen
        d, e = distances(home, vp), distances(visit, vp)
        inner, outer = home[d <= t], home[d > t]
        near = home[(d > t) & (d - bits <= t)]
        stack.append((inner, np.concatenate([visit[e - bits <= t], near])))
        stack.append((outer, visit[e + bits > t]))


def _all_close(home, visit, bits):
    step = max(1, (1 << 20) // len(home))
    everyone = np.concatenate([home, visit])
    for a in range(0, len(everyone), step):
        part = everyone[a : a + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ home[None]) <= bits)
        real = part[i] != home[j]
        yield part[i[real]], home[j[real]]


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Links (u, v) that join exactly the fingerprints which chains of pairs within ``bits`` join.

    fps: distinct fingerprints in a column fp. Of the pairs of a shard a spanning forest is kept, one link
    per row at most. The top of the tree is fitted on the ``sample`` fingerprints of lowest hash; which
    they are changes the shards but not the links' components.
    """
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    chosen = [r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()] if depth else []
    tree = build_top(np.array(chosen, np.int64).view(np.uint64), depth, bits, np.random.default_rng(5)) if depth else None

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame["fp"].to_numpy(np.int64)
            row, to, home = route(tree, values.view(np.uint64), bits)
            yield pd.DataFrame({"shard": to, "fp": values[row], "home": home})

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        values, home = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["home"].to_numpy(bool)
        links: list[tuple[int, int]] = []
        for a, b in close_pairs(np.sort(values[home]), np.sort(values[~home]), bits, np.random.default_rng(11)):
            links += forest(a.view(np.int64).tolist(), b.view(np.int64).tolist())
            if len(links) > 1 << 18:
                links = forest(*map(list, zip(*links, strict=True)))
        if links:
            links = forest(*map(list, zip(*links, strict=True)))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    dealt = fps.select("fp").mapInPandas(deal, "shard bigint, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "u bigint, v bigint")


def simhash_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, bits: int = MAX_BITS, shard: int = SHARD
) -> DataFrame:
    """One row per row of docs: key, fingerprint (16 lower-case hex digits), component_id (smallest key reachable).

    Equal fingerprints are one node of the search, however many rows have them. Rows without words share
    the fingerprint 0. A null key never names a component unless all keys of the component are null. An
    empty table gives an empty result.
    """
    marked = cut_lineage(with_fingerprint(docs, key, text, words))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min(key).alias("least")))
    roots = connected_components(fingerprint_links(nodes.select("fp"), bits, shard))
    linked = nodes.join(roots, F.col("fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("least").alias("_least"))
    moved = linked.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), "_least")
    named = cut_lineage(
        nodes.join(moved, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_fp"), F.coalesce("_least", "least").alias("component_id"))
    )
    return marked.join(named, F.col("fp") == F.col("_fp")).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of every component, the one with the smallest key; columns as given.

    Of equal keys that with the smallest hash of its text stays, null keys come last, and of rows with the
    same key and text one stays. So near copies under null or repeated keys go like any others.
    """
    # what tells rows apart; structures are ordered by their first field, then the next
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    grouped = simhash_groups(docs.select(row.alias("_row"), F.col(text).alias("_text")), key="_row", text="_text", **options)
    first = grouped.where(F.col("_row").eqNullSafe(F.col("component_id")))
    found = first.groupBy("_row").agg(F.count("*").alias("_rows"))
    # names that no column of the documents has
    own_key, own_hash, rows = (f"_{n}" + "_" * max(len(c) for c in docs.columns) for n in ("key", "hash", "rows"))
    named = found.select(F.col("_row.key").alias(own_key), F.col("_row.hash").alias(own_hash), F.col("_rows").alias(rows))
    chosen = cut_lineage(named)
    same = F.col(key).eqNullSafe(F.col(own_key)) & (F.xxhash64(text) == F.col(own_hash))
    kept = lambda c: docs.join(c, same, "left_semi")
    once, repeated = chosen.where(F.col(rows) == 1), chosen.where(F.col(rows) > 1)
    if repeated.isEmpty():
        return kept(chosen)
    return kept(once).unionByName(kept(repeated).dropDuplicates([key, text]))
