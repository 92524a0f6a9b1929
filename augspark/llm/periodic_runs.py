"""Periodic runs of words, found with a run-length grammar built by recompression.

The words of a block of texts become one sequence of numbers, with a number of its own between any two
texts. Recompression replaces, in turn, all blocks of one repeated symbol and all pairs of a left and a
right symbol, until no symbol occurs twice. Equal stretches are replaced alike but for their margins, so
the longest common extension of two places follows from a walk up and down the levels of the grammar.

A run of period q and at least three periods holds two neighbouring multiples of q. Multiples of every q
(a harmonic number of them in all) at which words agree are the candidates; the grammar gives their exact
extensions to both sides. Queries and grammar steps work on whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from augspark.llm.arrays import SpanHash, text_blocks, word_spans

MIN_LENGTH, MIN_PERIODS = 24, 3
# Candidates that are extended together, and grid points that are compared together
QUERIES, GRID = 1 << 17, 1 << 20
# Rounds in which symbols choose the side on which they form more pairs
SIDE_ROUNDS = 4


class Grammar:
    """levels: the symbols of each level. starts: for each level above 0, where its symbols start in the level below.

    blocks: whether a level came from blocks (else from pairs). The first and the last symbol of the
    sequence must occur once, so that no extension leaves it.
    """

    def __init__(self, levels: list[np.ndarray], starts: list[np.ndarray], blocks: list[bool]):
        self.levels, self.starts, self.blocks = levels, starts, blocks
        # per level: the symbol of the next level that holds a place, and the place where that symbol ends
        self.up = [np.repeat(np.arange(len(s), dtype=np.int32), np.diff(s, append=len(x))) for x, s in zip(levels, starts, strict=False)]
        self.end = [np.append(s[1:], len(x)) for x, s in zip(levels, starts, strict=False)]

    def mirrored(self) -> Grammar:
        starts = [(len(x) - e)[::-1].astype(np.int32) for x, e in zip(self.levels, self.end, strict=False)]
        return Grammar([x[::-1] for x in self.levels], starts, self.blocks)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i[k] on equal those from j[k] on; i[k] and j[k] differ."""
        x, y = i.astype(np.int64), j.astype(np.int64)
        live = np.arange(len(x))
        stopped: list[np.ndarray] = []
        for t, symbols in enumerate(self.levels):
            same = symbols[x[live]] == symbols[y[live]]
            stop = [live[~same]]
            live = live[same]
            if len(live):  # never on the last level, where all symbols differ
                up, starts = self.up[t], self.starts[t]
                a, b = x[live], y[live]
                at_start = (starts[up[a]] == a) & (starts[up[b]] == b)
                if self.blocks[t]:
                    # both go to the end of the nearer block; unless both end there, the next symbols differ
                    left, right = self.end[t][up[a]] - a, self.end[t][up[b]] - b
                    step = np.where(at_start, 0, np.minimum(left, right))
                    a, b = a + step, b + step
                    apart = ~at_start & (left != right)
                else:
                    # one symbol on, the borders agree if the symbols do; a right symbol is followed by a border
                    a, b = a + ~at_start, b + ~at_start
                    apart = symbols[a] != symbols[b]
                    inside = ~apart & (starts[up[a]] != a)
                    a, b = a + inside, b + inside
                    apart &= ~at_start
                x[live], y[live] = np.where(apart, a, up[np.minimum(a, len(up) - 1)]), np.where(apart, b, up[np.minimum(b, len(up) - 1)])
                stop.append(live[apart])
                live = live[~apart]
            stopped.append(np.concatenate(stop))
        down = np.zeros(0, np.int64)
        for t in range(len(self.levels) - 1, 0, -1):
            down = np.concatenate([down, stopped[t]])
            if not len(down):
                continue
            starts, symbols = self.starts[t - 1], self.levels[t - 1]
            a, b = starts[x[down]].astype(np.int64), starts[y[down]].astype(np.int64)
            same = symbols[a] == symbols[b]
            if self.blocks[t - 1]:
                left, right = self.end[t - 1][x[down]] - a, self.end[t - 1][y[down]] - b
                step = np.where(same, np.minimum(left, right), 0)
            else:
                step = same.astype(np.int64)
            x[down], y[down] = a + step, b + step
        return x - i


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    numbers, distinct = pd.factorize(keys)
    return numbers.astype(np.int64), len(distinct)


def recompress(sequence: np.ndarray, seed: int = 5) -> Grammar:
    """The grammar of a sequence of numbers from 0 on."""
    rng = np.random.default_rng(seed)
    symbols, many = _numbered(sequence)
    levels, starts, blocks = [symbols], [], []
    while many < len(symbols):
        first = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1])
        if len(first) < len(symbols):
            size = np.diff(first, append=len(symbols))
            symbols, many = _numbered(symbols[first] * (int(size.max()) + 1) + size)
            levels.append(symbols)
            starts.append(first.astype(np.int32))
            blocks.append(True)
            continue
        paired = _pairs(symbols, many, rng)
        if not paired.any():
            continue
        first = np.flatnonzero(~np.concatenate([[False], paired]))
        second = np.where(np.append(paired, False)[first], symbols[np.minimum(first + 1, len(symbols) - 1)] + 1, 0)
        symbols, many = _numbered(symbols[first] * (many + 1) + second)
        levels.append(symbols)
        starts.append(first.astype(np.int32))
        blocks.append(False)
    return Grammar(levels, starts, blocks)


def _pairs(symbols: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """Which places start a pair of a left and a right symbol; sides are drawn and then improved."""
    left = rng.random(many) < 0.5
    before, after = symbols[:-1], symbols[1:]
    for _ in range(SIDE_ROUNDS):
        as_left = np.bincount(before, ~left[after], many)
        as_right = np.bincount(after, left[before], many)
        left = np.where(rng.random(many) < 0.5, as_left > as_right, left)
    return left[before] & ~left[after]


def grid_candidates(sequence: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of multiples q at which a run of period q may lie.

    Texts come in descending order of their sizes and end before ``ends``. The words at a place, a period
    and two periods on must agree, and those after the first two.
    """
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def compare(at: np.ndarray, q: np.ndarray) -> None:
        for step, other in ((0, 1), (0, 2), (1, 1)):
            good = sequence[at + step] == sequence[at + step + other * q]
            at, q = at[good], q[good]
        places.append(at)
        periods.append(q)

    longest = int(sizes[0]) // MIN_PERIODS if len(sizes) else 0
    q = np.arange(1, longest + 1)
    # texts long enough for a run of that period come first
    texts = np.searchsorted(-sizes, -np.maximum(MIN_LENGTH, MIN_PERIODS * q), "right")
    reach = np.where(texts > 0, ends[np.maximum(texts - 1, 0)], 0)
    count = np.maximum((reach - 1) // q - 2, 0)  # multiples q, 2q, ... below reach - 2q
    sums = np.cumsum(count)
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + GRID, "right")))
        of = np.repeat(q[lo:hi], count[lo:hi])
        rank = np.arange(1, len(of) + 1) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi])
        compare(rank * of, of)
        lo = hi
    return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of all runs, ordered by text, start, period; words: numbers of all texts' words in a row."""
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= MIN_LENGTH]
    size = sizes[order]
    # a border before, between and after the texts; borders have numbers of their own
    begins = np.cumsum(size + 1) - size
    sequence = np.full(int((size + 1).sum()) + 1, -1, np.int64)
    place = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    source = np.repeat((np.cumsum(sizes) - sizes)[order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    sequence[place] = words[source]
    borders = np.flatnonzero(sequence < 0)
    sequence[borders] = (int(words.max()) + 1 if len(words) else 0) + np.arange(len(borders))
    at, period = grid_candidates(sequence, begins + size, size)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none
    # only texts with candidates enter the grammar
    text = np.searchsorted(begins, at, "right") - 1
    wanted = np.zeros(len(size), bool)
    wanted[text] = True
    kept = np.concatenate([[True], np.repeat(wanted, size + 1)])
    moved = np.cumsum(kept) - 1
    grammar = recompress(sequence[kept])
    mirror = grammar.mirrored()
    last = int(moved[-1])
    found = []
    for lo in range(0, len(at), QUERIES):
        i, q = moved[at[lo : lo + QUERIES]], period[lo : lo + QUERIES]
        ahead = grammar.extension(i, i + q)
        behind = mirror.extension(last - (i - 1), last - (i - 1 + q))
        length = ahead + behind + q
        good = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * q)
        start = at[lo : lo + QUERIES] - behind
        found.append(np.unique(np.stack([start[good], length[good], q[good]]), axis=1))
    start, length, q = np.unique(np.concatenate(found, axis=1), axis=1)
    # of equal stretches the smallest period
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])[: len(start)]
    start, length, q = start[first], length[first], q[first]
    text = np.searchsorted(begins, start, "right") - 1
    text, start = order[text], start - begins[text]
    by = np.lexsort((q, start, text))
    return text[by], start[by], length[by], q[by]


def _collapsed(buf: np.ndarray, first: np.ndarray, last: np.ndarray, text: np.ndarray, kept: np.ndarray, n: int) -> pa.Array:
    """The kept words of each text joined by one space."""
    first, last, text = first[kept], last[kept], text[kept]
    size = last - first + 1  # with a space after the word
    total = int(size.sum())
    source = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)
    out = buf[np.minimum(source, len(buf) - 1)] if total else np.zeros(0, np.uint8)
    word_end = np.cumsum(size) - 1
    out[word_end] = 0x20
    inside = np.ones(total, bool)
    closing = np.flatnonzero(np.append(text[1:] != text[:-1], True))[: len(text)]
    inside[word_end[closing]] = False
    sizes = np.bincount(text, size, n).astype(np.int64) - (np.bincount(text, minlength=n) > 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[inside].tobytes()))
    return data.cast(pa.string())


def _runs_of(key: str, key_type: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, _, ends in text_blocks(batch.column(1)):
            n = hi - lo
            first, last, text = word_spans(buf, ends)
            words, _ = _numbered(SpanHash(buf)(first, last))
            sizes = np.bincount(text, minlength=n)
            of, start, length, period = find_runs(words, sizes)
            # words after the first period of some run
            marks = np.zeros(len(words) + 1, np.int64)
            begin = (np.cumsum(sizes) - sizes)[of] + start
            np.add.at(marks, begin + period, 1)
            np.add.at(marks, begin + length, -1)
            kept = np.cumsum(marks)[:-1] == 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32))
            fields = [pa.array(v.astype(np.int64)) for v in (start, length, period)]
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            collapsed = _collapsed(buf, first, last, text, kept, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi].cast(key_type), pa.array(sizes.astype(np.int64)), runs, collapsed], names=[key, "n_words", "runs", "collapsed"]
            )


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`, counted from 0. A run is a stretch of words with smallest period q,
    at least MIN_PERIODS periods and MIN_LENGTH words long, that no neighbouring word extends. collapsed:
    the words left when each run keeps its first period only, joined by one space.

    Null and empty texts have no words and no runs. Rows are handled one by one, so repeated keys or rows
    do no harm, and nothing is shuffled; a text is held whole by one task. No rows give no rows. Hashes of
    64 bits stand for words.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key), F.col(text).cast("binary").alias("_data" if key != "_data" else "_data_"))
    schema = f"`{key}` {kind.simpleString()}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _runs_of(key, batch.schema.field(0).type, iter([batch]))

    return rows.mapInArrow(run, schema)
