"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. For each decision every context (the last 0 to DEPTH bytes) has a
Krichevsky-Trofimov estimate from the training counts, and the estimates of all depths are mixed with
the weights that context-tree weighting gives them. The chance of a byte depends on it and the bytes
before it only, so texts are reduced to distinct windows of DEPTH + 1 bytes per run of documents. The
windows meet the counts by their last two context bytes, under which a whole subtree lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from augspark.llm.arrays import BLOCK_BYTES, SpanHash, byte_table, lower_ascii, mix, text_blocks
from augspark.llm.runs import dealt_into_runs, pack_sorted, run_count, sorted_counts, unpack_sorted
from augspark.session import scratch_path

DEPTH = 5
# Groups of subtrees that are handled together
BUCKETS = 64
# Texts of a run: the larger, the fewer windows are asked for twice
RUN_BYTES = 16 << 20
# The byte that ends a text, and the context before its first byte; no word has it
END = 0x0A
_HALF = np.log(0.5)


def plain_bytes(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as lower-case words joined by one space and closed by END: (bytes, starts, stops, words of each)."""
    n = len(ends)
    space = byte_table((0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))[buf]
    after_word = space & np.concatenate([[False], ~space[:-1]]) if len(buf) else space
    close = np.zeros(len(buf), bool)
    close[ends] = True  # the gap byte of every text becomes its END
    word_at = np.cumsum(after_word)
    words = np.diff(word_at[ends], prepend=0) if n else np.zeros(0, np.int64)
    # the separator after a text's last word is left out, unless it is the gap byte itself
    last_one = np.zeros(len(buf), bool)
    at = np.flatnonzero(after_word)
    if len(at):
        last_one[at[word_at[ends][words > 0] - 1]] = True
    kept = (~space | after_word) & ~last_one | close
    out = lower_ascii(buf)
    out[after_word] = 0x20
    out[close] = END
    place = np.cumsum(kept)
    stops = place[ends]
    return out[kept], np.concatenate([[0], stops[:-1]]), stops, words


def windows(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For every byte: its context, latest byte in the highest place, and the byte itself in the lowest.

    depth: 1 to 7 bytes of context.
    """
    n = len(starts)
    # every text behind 8 END bytes, so that one 8-byte number holds all the bytes before a byte
    spread = np.full(len(data) + 8 * n + 8, END, np.uint8)
    place = np.arange(len(data)) + np.repeat(8 * np.arange(1, n + 1), stops - starts)
    spread[place] = data
    before = np.ndarray((len(spread) - 7,), "<u8", spread, 0, (1,))[place - 8]
    return (before >> np.uint64(8 * (8 - depth)) << np.uint64(8)) | data


def bucket_of(window: np.ndarray, buckets: int, depth: int = DEPTH) -> np.ndarray:
    """The bucket of a window: from the last two bytes of its context."""
    return (mix(window >> np.uint64(8 * (depth - 1))) % np.uint64(buckets)).astype(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma of positive numbers, by Stirling's series above 10."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        if not low.any():
            break
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov chance of a sequence with these counts."""
    a, b = zeros.astype(float), ones.astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


@dataclass
class Level:
    """The decision nodes of one context depth, sorted by node: context, then the bits so far behind a 1."""

    node: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_weighted: np.ndarray
    keep: np.ndarray  # the weight of the node's own estimate against those below it

    def chance_of_one(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def nodes(window: np.ndarray, count: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decision nodes of the contexts without their ``drop`` oldest bytes, with their counts of 0 and 1."""
    key = (window >> np.uint64(8 * (drop + 1)) << np.uint64(8)) | (window & np.uint64(255)) if drop else window
    key, count = sorted_counts(key, count)
    context, byte = key >> np.uint64(8), key & np.uint64(255)
    ids, zeros, ones = [], [], []
    for bit in range(8):
        node = (context << np.uint64(8)) | np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))
        up = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        if len(first):
            ids.append(node[first])
            zeros.append(np.add.reduceat(np.where(up, 0, count), first))
            ones.append(np.add.reduceat(np.where(up, count, 0), first))
    if not ids:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(np.concatenate(ids))
    return np.concatenate(ids)[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def level(node, zeros, ones, below: np.ndarray | None) -> Level:
    """below: ln of the product of the children's weighted chances; None at the deepest level."""
    own = estimate(zeros, ones)
    if below is None:
        return Level(node, zeros, ones, own, np.ones(len(node)))
    weighted = np.logaddexp(_HALF + own, _HALF + below)
    return Level(node, zeros, ones, weighted, np.exp(_HALF + own - weighted))


def parents(child: Level) -> tuple[np.ndarray, np.ndarray]:
    """The nodes one context byte shorter, and the sum of their children's weighted logarithms."""
    node = (child.node >> np.uint64(16) << np.uint64(8)) | (child.node & np.uint64(255))
    return sorted_counts(node, child.log_weighted)


class Lookup:
    """Values of distinct 64-bit keys in an open hash table, read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        self.keys, self.values = keys, values
        left = np.arange(len(keys))
        slot = (mix(keys) >> self.shift).astype(np.int64)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of several keys for one slot the last one stays
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask
        self.slot_keys = keys[np.maximum(self.slots, 0)] if len(keys) else np.zeros(len(self.slots), np.uint64)
        self.slot_values = values[np.maximum(self.slots, 0)] if len(keys) else np.zeros(len(self.slots), values.dtype)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The values of keys that are all in the table."""
        slot = (mix(wanted) >> self.shift).astype(np.int64)
        out = self.slot_values[slot]
        left = np.flatnonzero(self.slot_keys[slot] != wanted)
        while len(left):
            slot_left = (slot[left] + 1) & self.mask
            slot[left] = slot_left
            out[left] = self.slot_values[slot_left]
            left = left[self.slot_keys[slot_left] != wanted[left]]
        return out


def subtree(window: np.ndarray, count: np.ndarray, depth: int = DEPTH, top: int = 2) -> list[Level]:
    """Levels ``top`` to ``depth`` over the windows of whole subtrees."""
    found: list[Level] = []
    for d in range(depth, top - 1, -1):
        node, zeros, ones = nodes(window, count, depth - d)
        below = parents(found[-1])[1] if found else None
        found.append(level(node, zeros, ones, below))
    return found[::-1]


def log10_chances(window: np.ndarray, levels: list[Level], depth: int = DEPTH) -> np.ndarray:
    """log10 of the chance of each window's byte; levels: all depths from 0.

    Depths whose context was never seen in training have nothing to say; the mix ends above them.
    """
    byte = window & np.uint64(255)
    out = np.zeros(len(window))
    for bit in range(8):
        prefix = np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))
        one = np.full(len(window), 0.5)
        started = np.zeros(len(window), bool)
        for d in range(depth, -1, -1):
            lv = levels[d]
            if not len(lv.node):
                continue
            node = (window >> np.uint64(8 * (depth - d + 1)) << np.uint64(8)) | prefix
            at = np.minimum(np.searchsorted(lv.node, node), len(lv.node) - 1)
            seen = lv.node[at] == node
            keep = np.where(started, lv.keep[at], 1.0)
            one = np.where(seen, keep * lv.chance_of_one()[at] + (1 - keep) * one, one)
            started |= seen
        up = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        out += np.log10(np.where(up, one, 1 - one))
    return out


def _texts(table: pa.Table) -> pa.Array:
    column = table.column("data").combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _word_hashes(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of plain bytes."""
    edge = np.diff(((data != 0x20) & (data != END)).astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return SpanHash(data)(first, last), np.searchsorted(stops, first, "right")


def _distinct(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct windows, then distinct word hashes of a run's texts, with how often its training texts have them."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    train = np.array(table.column("train").to_pylist(), bool)
    for lo, hi, buf, _, ends in text_blocks(_texts(table), BLOCK_BYTES):
        data, starts, stops, _ = plain_bytes(buf, ends)
        use = np.repeat(train[lo:hi], stops - starts)
        values = windows(data, starts, stops)
        hashes, text = _word_hashes(data, stops)
        for parts, each, learn in ((found[0], values, use), (found[1], hashes, train[lo:hi][text])):
            parts.append(sorted_counts(each[learn]))
            unseen = sorted_counts(each[~learn])[0]
            parts.append((unseen, np.zeros(len(unseen), np.int64)))
    empty = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    return [sorted_counts(*map(np.concatenate, zip(*(f or empty), strict=True))) for f in found]


def _by_bucket(run: int, found: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.Table:
    """Messages of a run: windows in buckets from 0, word hashes in buckets from ``buckets``."""
    out: dict[str, list] = {"bucket": [], "run": [], "windows": [], "counts": []}
    for kind, (values, counts) in enumerate(found):
        to = bucket_of(values, buckets) if kind == 0 else (values % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[b] : cuts[b + 1]]
            out["bucket"].append(kind * buckets + int(b))
            out["run"].append(run)
            out["windows"].append(pack_sorted(values[at]))
            out["counts"].append(counts[at].astype("<u4").tobytes())
    types = {"bucket": pa.int32(), "run": pa.int32(), "windows": pa.binary(), "counts": pa.binary()}
    return pa.table({k: pa.array(out[k], t) for k, t in types.items()})


@dataclass
class ContextTree:
    """A fitted tree: counts of windows and words by bucket, stored in the shared folder, and the nodes of depth 0 and 1.

    asked: the windows and words of every run, which are to be scored. tokens: words and end marks in training; kinds: how many of them are distinct; texts: training texts.
    """

    asked: DataFrame
    stored: DataFrame
    top: list[Level]
    buckets: int
    tokens: int
    kinds: int
    texts: int


def _ensure_binary(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def fit_context_tree(dealt: DataFrame, buckets: int = BUCKETS) -> ContextTree:
    """A tree from the rows of dealt runs whose column ``train`` is true.

    Counts cover all training rows. The levels of depth 0 and 1 have at most 257 x 255 nodes and come to
    the driver; everything below stays in its bucket.
    """
    spark = dealt.sparkSession

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _by_bucket(key[0].as_py(), _distinct(table), buckets)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held_v, held_c, held = [], [], 0
        for w, c in zip(_ensure_binary(table, "windows"), _ensure_binary(table, "counts"), strict=True):
            held_v.append(unpack_sorted(w))
            held_c.append(np.frombuffer(c, "<u4").astype(np.int64))
            held += len(held_c[-1])
            if held > 4_000_000:  # bounds what is held beside the merged counts
                values, counts = sorted_counts(np.concatenate([values, *held_v]), np.concatenate([counts, *held_c]))
                held_v, held_c, held = [], [], 0
        values, counts = sorted_counts(np.concatenate([values, *held_v]), np.concatenate([counts, *held_c]))
        values, counts = values[counts > 0], counts[counts > 0]
        if key[0].as_py() < buckets:
            second = subtree(values, counts)[0]
            node, below = parents(second)
            shorter = (second.node >> np.uint64(16) << np.uint64(8)) | (second.node & np.uint64(255))
            parts = [node.astype("<i8"), sorted_counts(shorter, second.zeros)[1], sorted_counts(shorter, second.ones)[1]]
        else:
            parts, below = [np.array([-1]), np.array([counts.sum()]), np.array([(counts > 0).sum()])], np.zeros(1)
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()], pa.int32()),
                "windows": pa.array([pack_sorted(values)], pa.binary()),
                "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
                "node": pa.array([parts[0].tolist()], pa.list_(pa.int64())),
                "zeros": pa.array([parts[1].tolist()], pa.list_(pa.int64())),
                "ones": pa.array([parts[2].tolist()], pa.list_(pa.int64())),
                "below": pa.array([below.tolist()], pa.list_(pa.float64())),
            }
        )

    asked_path = scratch_path(spark, "context-windows")
    counted = dealt.groupBy("run").applyInArrow(count, "bucket int, run int, windows binary, counts binary")
    counted.write.parquet(asked_path)
    asked = spark.read.schema(counted.schema).parquet(asked_path)
    merged = asked.groupBy("bucket").applyInArrow(
        merge,
        "bucket int, windows binary, counts binary, node array<bigint>, zeros array<bigint>, ones array<bigint>, below array<double>",
    )
    path = scratch_path(spark, "context-tree")
    merged.write.parquet(path)
    stored = spark.read.schema(merged.schema).parquet(path)
    slim = stored.select(F.explode(F.arrays_zip("node", "zeros", "ones", "below")).alias("x")).select("x.*")
    rows = slim.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    rows = rows.orderBy("node").collect()  # at most 257 x 255, and one of the words
    words = [r for r in rows if r["node"] == -1]
    rows = [r for r in rows if r["node"] >= 0]
    texts = dealt.where("train").count()
    first = level(*(np.array([r[c] for r in rows], np.int64) for c in ("node", "zeros", "ones")), np.array([r["below"] for r in rows], float))
    first.node = first.node.astype(np.uint64)
    node, below = parents(first)
    low = first.node & np.uint64(255)
    root = level(node, sorted_counts(low, first.zeros)[1], sorted_counts(low, first.ones)[1], below)
    tokens = texts + sum(r["zeros"] for r in words)
    kinds = sum(r["ones"] for r in words) + (texts > 0)
    return ContextTree(asked.select("bucket", "run", "windows"), stored.select("bucket", "windows", "counts"), [root, first], buckets, tokens, kinds, texts)


def score_context_tree(dealt: DataFrame, tree: ContextTree) -> DataFrame:
    """Per row of dealt runs: key, score, code_length, n_plain, n_tokens, n_known, base_score.

    score: log10 of the chance of the text's lower-case words, joined by one space and closed by an end
    mark. code_length: bits per byte of that, n_plain bytes in all. base_score: the same tokens (words and
    the end mark) under add-one word counts; n_known of the n_tokens occur in training.
    """
    buckets, top = tree.buckets, tree.top
    tokens, kinds, known_ends = tree.tokens, tree.kinds, tree.texts
    key_type = dealt.schema["key"].dataType.simpleString()

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
        schema = {"run": pa.int32(), "bucket": pa.int32(), "windows": pa.binary(), "chances": pa.binary()}
        runs, asks = asked.column("run").to_pylist(), [unpack_sorted(w) for w in _ensure_binary(asked, "windows")]
        if not asks:
            return pa.table({k: pa.array([], t) for k, t in schema.items()})
        if known.num_rows:
            values = unpack_sorted(known.column("windows")[0].as_py())
            counts = np.frombuffer(known.column("counts")[0].as_py(), "<i8")
        else:
            values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if asked.column("bucket")[0].as_py() < buckets:
            levels = [*top, *subtree(values, counts)]
            each = sorted_counts(np.concatenate(asks))[0]
            chances = np.concatenate([log10_chances(each[a : a + 500_000], levels) for a in range(0, len(each), 500_000)])
            out = [chances[np.searchsorted(each, a)].astype("<f4").tobytes() for a in asks]
        else:
            values, counts = np.append(values, np.uint64(2**64 - 1)), np.append(counts, 0)
            at = [np.minimum(np.searchsorted(values, a), len(values) - 1) for a in asks]
            out = [np.where(values[i] == a, counts[i], 0).astype("<u4").tobytes() for a, i in zip(asks, at, strict=True)]
        columns = {"run": runs, "bucket": asked.column("bucket").to_pylist(), "windows": asked.column("windows").to_pylist(), "chances": out}
        return pa.table({k: pa.array(columns[k], t) for k, t in schema.items()})

    def total(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        n = texts.num_rows
        found: list[tuple[list, list]] = [([], []), ([], [])]
        for b, w, c in zip(answers.column("bucket").to_pylist(), _ensure_binary(answers, "windows"), _ensure_binary(answers, "chances"), strict=True):
            keys, values = found[b >= buckets]
            keys.append(unpack_sorted(w))
            values.append(np.frombuffer(c, "<u4" if b >= buckets else "<f4"))
        chances, counts = (Lookup(np.concatenate([np.zeros(0, np.uint64), *k]), np.concatenate([np.zeros(0), *v])) for k, v in found)
        out = {c: np.zeros(n) for c in ("score", "base_score")} | {c: np.zeros(n, np.int64) for c in ("n_plain", "n_tokens", "n_known")}
        for lo, hi, buf, _, ends in text_blocks(_texts(texts), BLOCK_BYTES):
            data, starts, stops, words = plain_bytes(buf, ends)
            out["score"][lo:hi] = np.add.reduceat(chances(windows(data, starts, stops)), starts)
            h, text = _word_hashes(data, stops)
            count = counts(h)
            base = np.log10((count + 1) / (tokens + kinds + 1))
            out["base_score"][lo:hi] = np.bincount(text, base, hi - lo) + np.log10((known_ends + 1) / (tokens + kinds + 1))
            out["n_tokens"][lo:hi] = words + 1
            out["n_known"][lo:hi] = np.bincount(text, count > 0, hi - lo).astype(np.int64) + (known_ends > 0)
            out["n_plain"][lo:hi] = stops - starts
        out["code_length"] = -out["score"] / np.log10(2) / np.maximum(out["n_plain"], 1)
        names = ["score", "code_length", "n_plain", "n_tokens", "n_known", "base_score"]
        return pa.table({"key": texts.column("key")} | {c: pa.array(out[c]) for c in names})

    answered = tree.asked.groupBy("bucket").cogroup(tree.stored.groupBy("bucket")).applyInArrow(
        answer, "run int, bucket int, windows binary, chances binary"
    )
    return dealt.groupBy("run").cogroup(answered.groupBy("run")).applyInArrow(
        total, f"key {key_type}, score double, code_length double, n_plain bigint, n_tokens bigint, n_known bigint, base_score double"
    )


def language_scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """Per row: key, the columns of :func:`score_context_tree`, train_tokens; the tree learns from rows where ``train`` holds.

    Null texts count as empty and consist of the end mark only. Equal rows get equal scores. Without
    training rows every decision has the chance one half. An empty table gives an empty result.
    """
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    runs = run_count(texts, "_text", run_bytes)
    dealt = dealt_into_runs(texts, runs, "_key", "_text", [F.col("_train").alias("train")])
    tree = fit_context_tree(dealt, buckets)
    return score_context_tree(dealt, tree).withColumn("train_tokens", F.lit(tree.tokens).cast("bigint")).withColumnRenamed("key", key)
