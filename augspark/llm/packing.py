"""Mixture-controlled packing: deficit round-robin over source queues fills windows of tokens.

Every source is a queue of its documents' tokens. A window gives each source a quantum of tokens in
proportion to its weight; what a source is owed or has taken too much is its deficit, which goes on to
the next window. The deficits at the first window of a block of windows follow from the block's place
alone, so blocks are laid out by different tasks and still carry the deficits of all blocks before.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from augspark.llm.arrays import SpanHash, byte_table, lower_ascii, text_blocks, word_spans, worker_state
from augspark.operators.skew import broadcast_if_small
from augspark.session import cut_lineage, scratch_path

WINDOW = 4096
END_ID = 2
# Windows that are laid out together
BLOCK_WINDOWS = 64
# Words whose ids a worker remembers; beyond that it starts anew
CACHE_WORDS = 1_000_000


class WordCache:
    """Token ids of words, looked up by hash.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    words. Trailing marks are separate words where a letter or digit of ASCII or Latin-1 stands before
    them: letters and marks are separate for the tokenizer as well. A text with ``<|`` may name special
    tokens and goes to the tokenizer as a whole. Hashes have 64 bits; two words of one cache share one
    with a probability below 10^-6.
    """

    def __init__(self, path: str):
        # one thread a task: Spark deals out the cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> list[list[int]]:
        # without offsets, which nothing here needs
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _word_ids(self, buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words in another order, the ids of all of them one after the other, and how many each has.

        Words of letters are one piece each, and the last token of a piece is marked as the end of a word,
        so many of them can go through the tokenizer as one text.
        """
        plain = letter_spans(buf, first, last)
        letters = np.flatnonzero(plain)
        lists = [letters[a : a + 512] for a in range(0, len(letters), 512)]
        order, ids, sizes, rest = [], [], [], [np.flatnonzero(~plain)]
        for part, found in zip(lists, self._encode([_joined(buf, first[x], last[x]) for x in lists]), strict=True):
            found = np.array(found, np.uint32)
            cuts = np.flatnonzero(self.ends_word[found]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(found):
                rest.append(part)
                continue
            order.append(part)
            ids.append(found)
            sizes.append(np.diff(cuts, prepend=0))
        rest = np.concatenate(rest)
        view = memoryview(buf)
        for i, x in zip(rest, self._encode([str(view[a:b], "utf-8", "replace") for a, b in zip(first[rest], last[rest], strict=True)]), strict=True):
            order.append([i])
            ids.append(np.array(x, np.uint32))
            sizes.append([len(x)])
        return np.concatenate(order), np.concatenate(ids), np.concatenate(sizes).astype(np.int64)

    def _learn(self, keys: np.ndarray, buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Enters words by their keys, which are sorted and new."""
        order, flat, size = self._word_ids(buf, first, last)
        begin = len(self.pool) + np.cumsum(size) - size
        back = np.argsort(order)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, begin[back])
        self.size = np.insert(self.size, at, size[back])
        self.pool = np.concatenate([self.pool, flat])

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and how many each has."""
        raw, n = buf, len(starts)
        buf = lower_ascii(buf)
        first, last, doc = word_spans(buf, ends)
        if len(first):
            first, last, doc = _split_marks(buf, first, last, doc)
        hashes = SpanHash(buf)(first, last)
        inverse, keys = pd.factorize(hashes, sort=True)
        where = np.zeros(len(keys), np.int64)
        where[inverse[::-1]] = np.arange(len(inverse))[::-1]
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = where[~known]
            self._learn(keys[~known], buf, first[new], last[new])
            at = np.searchsorted(self.keys, keys)
        size, begin = self.size[at][inverse], self.first[at][inverse]
        flat = self.pool[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        counts = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
        odd = [i for i in range(n) if b"<|" in memoryview(raw)[starts[i] : ends[i]].tobytes()] if b"<|" in raw.tobytes() else []
        if odd:
            parts = np.split(flat, np.cumsum(counts)[:-1])
            whole = self._encode([str(raw[starts[i] : ends[i]].tobytes(), "utf-8", "replace") for i in odd])
            for i, ids in zip(odd, whole, strict=True):
                parts[i], counts[i] = np.array(ids, np.uint32), len(ids)
            flat = np.concatenate(parts)
        return flat, counts


def letter_spans(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which spans of a lower-case buffer hold letters of ASCII and of the second Latin-1 row only."""
    before = np.concatenate([[0], buf[:-1]])
    second = (before == 0xC3) & (buf >= 0x80) & (buf < 0xC0) & (buf != 0x97) & (buf != 0xB7)
    other = ~(((buf >= 97) & (buf <= 122)) | (buf == 0xC3) | second)
    upto = np.concatenate([[0], np.cumsum(other, dtype=np.int64)])
    return upto[last] == upto[first]


def _joined(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> str:
    """Spans of the buffer as one text, a blank after each but the last."""
    size = last - first + 1
    source = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out = buf[np.minimum(source, len(buf) - 1)]
    out[np.cumsum(size) - 1] = 0x20
    return str(out[:-1].tobytes(), "utf-8", "replace")


def _split_marks(buf, first, last, doc):
    """Cuts the trailing run of ``.,!?;:`` off words in which a plain letter or digit stands before it."""
    marks = byte_table(b".,!?;:")
    plain = byte_table([*range(48, 58), *range(65, 91), *range(97, 123)])
    cut = last.copy()
    for _ in range(8):  # longer runs stay with their word
        cut = np.where((cut > first + 1) & marks[buf[cut - 1]], cut - 1, cut)
    before, lead = buf[cut - 1], buf[np.maximum(cut - 2, 0)]
    latin = (lead == 0xC3) & (cut - 2 >= first) & (before != 0x97) & (before != 0xB7) & (before >= 0x80)
    good = (cut < last) & (plain[before] | latin)
    cut = np.where(good, cut, last)
    all_first = np.concatenate([first, cut[good]])
    all_last = np.concatenate([cut, last[good]])
    order = np.argsort(all_first, kind="stable")
    return all_first[order], all_last[order], np.concatenate([doc, doc[good]])[order]


class Schedule:
    """Which tokens of which queue fill which window.

    totals: tokens in each queue. weights: target proportions; the totals themselves if not given, so
    that all queues end together. With other weights a queue may end early; the others then share
    its part in proportion to their weights.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW):
        self.window, self.sources, self.total = window, len(totals), sum(totals)
        weights = [Fraction(w) for w in (weights or totals)]
        done = [0] * len(totals)
        # phases: (tokens before, tokens of each source before, tokens of each source in it)
        self.phases: list[tuple[int, list[int], list[int]]] = []
        while sum(done) < self.total:
            open_ = [s for s in range(len(totals)) if done[s] < totals[s]]
            live = [s for s in open_ if weights[s] > 0] or open_
            w = {s: weights[s] if weights[s] > 0 else Fraction(1) for s in live}
            z = min(Fraction(totals[s] - done[s]) / w[s] for s in live)
            part = [0] * len(totals)
            for s in live:
                # rounded up, so that a phase always ends at least one queue
                part[s] = min(totals[s] - done[s], -int(-(z * w[s]) // 1))
            self.phases.append((sum(done), done.copy(), part))
            done = [a + b for a, b in zip(done, part, strict=True)]
        self.blocks = -(-self.total // (window * BLOCK_WINDOWS))

    def _phase(self, at: int):
        return next((p for p in reversed(self.phases) if p[0] <= at), self.phases[0])

    def ideal(self, at: int) -> np.ndarray:
        """Tokens due from each source before token ``at`` of the output, as fractions of tokens."""
        before, base, part = self._phase(at)
        return np.array(base) + (at - before) * (np.array(part, float) / sum(part))

    def taken(self, at: int) -> list[int]:
        """Whole tokens of each source before token ``at``: the first ``at`` tokens by due time."""
        before, base, part = self._phase(at)
        u, m = at - before, sum(part)
        count = [(2 * u * p + m) // (2 * m) for p in part]
        live = [s for s, p in enumerate(part) if p]
        while sum(count) < u:
            s = min((s for s in live if count[s] < part[s]), key=lambda s: (Fraction(2 * count[s] + 1, part[s]), s))
            count[s] += 1
        while sum(count) > u:
            s = max((s for s in live if count[s]), key=lambda s: (Fraction(2 * count[s] - 1, part[s]), s))
            count[s] -= 1
        return [a + b for a, b in zip(base, count, strict=True)]

    def block(self, b: int) -> np.ndarray:
        """Tokens of each source before each window of block b, and after its last: deficit round-robin."""
        step = self.window * BLOCK_WINDOWS
        at, end = b * step, min((b + 1) * step, self.total)
        start = np.array(self.taken(at))
        left = np.array(self.taken(end)) - start
        deficit = self.ideal(at) - start
        rows = [start]
        while at < end:
            size = min(self.window, end - at)
            deficit += self.ideal(at + size) - self.ideal(at)
            take = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
            while take.sum() < size:
                s = int(np.argmax(np.where(take < left, deficit - take, -np.inf)))
                more = min(int(left[s] - take[s]), max(1, int(deficit[s] - take[s])), int(size - take.sum()))
                take[s] += more
            while take.sum() > size:
                s = int(np.argmin(np.where(take > 0, deficit - take, np.inf)))
                take[s] -= 1
            deficit -= take
            left = left - take
            rows.append(rows[-1] + take)
            at += size
        return np.array(rows)

    def find_block(self, source: int, position: int) -> int:
        """The block that holds token ``position`` of a queue."""
        step, lo, hi = self.window * BLOCK_WINDOWS, 0, self.blocks - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.taken(mid * step)[source] <= position:
                lo = mid
            else:
                hi = mid - 1
        return lo


def tokenized(docs: DataFrame, tokenizer_path: str, key: str, source: str, text: str, end_id: int = END_ID) -> DataFrame:
    """Per document: key, source, ids (little-endian unsigned 32-bit), n_tokens, task and place in the task's queue."""
    schema = f"task int, `{key}` bigint, source string, place bigint, n_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state(f"words:{tokenizer_path}", lambda: WordCache(tokenizer_path))
        task = TaskContext.get().partitionId()
        place: dict[str | None, int] = {}
        for batch in batches:
            for lo, hi, buf, starts, ends in text_blocks(batch.column(2)):
                flat, counts = cache.ids(buf, starts, ends)
                cuts = np.cumsum(counts + 1)
                whole = np.full(int(cuts[-1]), end_id, "<u4")
                inside = np.ones(len(whole), bool)
                inside[cuts - 1] = False
                whole[inside] = flat
                data = whole.tobytes()
                names = batch.column(1)[lo:hi].to_pylist()
                places = []
                for name, n in zip(names, (counts + 1).tolist(), strict=True):
                    places.append(place.get(name, 0))
                    place[name] = places[-1] + n
                offsets = pa.array(np.concatenate([[0], cuts * 4]).astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), hi - lo, [None, offsets.buffers()[1], pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(hi - lo, task, np.int32)),
                        batch.column(0)[lo:hi],
                        pa.array(names, pa.string()),
                        pa.array(places, pa.int64()),
                        pa.array(counts + 1, pa.int64()),
                        ids,
                    ],
                    names=["task", key, "source", "place", "n_tokens", "ids"],
                )

    return docs.select(F.col(key).cast("bigint"), F.col(source).cast("string"), F.col(text).cast("binary")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Mapping[str | None, float] | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents laid out in windows, one row per piece.

    Columns: key, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to and, on
    request, ids. A document's tokens are its ids and one ``end_id``; null and empty texts have the end id
    only. Every token lies in exactly one piece. Only the last window may be shorter; it is padded to the
    window, unless its length is a power of two. weights: target proportions by source; the sources'
    shares of all tokens by default, so that every window has the proportions of the whole table.

    The order of a queue is that of the stored rows. Rows with equal keys are packed each by itself, an
    empty table gives no row. Source names and their token totals go to the driver, one row per source.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    # stored: ids are computed once, and a lost executor does not change the order of a queue
    ids = tokenized(docs, tokenizer_path, key, source, text, end_id)
    ids.write.parquet(path)
    stored = spark.read.schema(ids.schema).parquet(path)
    parts = stored.groupBy("task", "source").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    begins = parts.select(
        F.col("task").alias("_task"), F.col("source").alias("_source"), F.coalesce(before, F.lit(0)).alias("_begin")
    )
    sums = parts.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()
    totals = {r["source"]: r["tokens"] for r in sums}
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    schedule = Schedule(
        [totals[s] for s in names], [weights.get(s, 0) for s in names] if weights is not None else None, window
    )
    # a row per task and source: broadcast after a count, else joined by its chunks, none larger than a task's share
    begins, _ = broadcast_if_small(cut_lineage(begins))
    placed = stored.join(begins, (F.col("task") == F.col("_task")) & F.col("source").eqNullSafe(F.col("_source")))
    rows = placed.select(key, "source", (F.col("_begin") + F.col("place")).alias("at"), "n_tokens", "ids")
    schema = (
        f"`{key}` bigint, source string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, padded_to bigint" + (", ids binary" if with_ids else "")
    )
    number = {s: i for i, s in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        current: dict[int, int] = {}

        def laid_out(b: int) -> np.ndarray:
            if b not in held:
                if len(held) >= 4096:
                    held.clear()
                held[b] = schedule.block(b)
            return held[b]

        for batch in batches:
            out: list[list] = [[] for _ in range(10 if with_ids else 9)]
            for doc, name, at, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                s, start = number[name], 0
                while start < n:
                    b = current.get(s, 0)
                    grid = laid_out(b)
                    if at >= grid[-1, s] and b + 1 < schedule.blocks:
                        b += 1
                        grid = laid_out(b)
                    if not grid[0, s] <= at < grid[-1, s]:
                        b = schedule.find_block(s, at)
                        grid = laid_out(b)
                    current[s] = b
                    w = int(np.searchsorted(grid[:, s], at, "right")) - 1
                    length = min(n - start, int(grid[w + 1, s]) - at)
                    lead = int((grid[w + 1, :s] - grid[w, :s]).sum())
                    piece = ids[4 * start : 4 * (start + length)]
                    size = int(grid[w + 1].sum() - grid[w].sum())
                    padded = size if size & (size - 1) == 0 else window
                    values = [doc, name, start, length, zlib.crc32(piece), n, b * BLOCK_WINDOWS + w, lead + at - int(grid[w, s]), padded]
                    for column, value in zip(out, [*values, piece] if with_ids else values, strict=True):
                        column.append(value)
                    start, at = start + length, at + length
            types = [pa.int64(), pa.string(), *[pa.int64()] * 7, *[pa.binary()] * with_ids]
            names_ = [key, "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names_)

    return rows.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed windows from pieces with ids: sequence_id, ids (little-endian unsigned 32-bit), n_tokens, padded_to."""
    parts: Column = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "").alias("_hex"),
        F.sum("length").alias("n_tokens"),
        F.max("padded_to").alias("padded_to"),
    ).select("sequence_id", F.unhex("_hex").alias("ids"), "n_tokens", "padded_to")
