"""Quality rules: a linear-chain conditional random field marks the lines of a text as content or boilerplate.

A line is described by plain facts (length, marks, capitals, symbols, repeats). The field has a weight
per fact and label and one per pair of neighbouring labels; the Viterbi path labels all lines of a text
at once. A text stays if enough of its words are in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from augspark.llm.arrays import SpanHash, byte_table, counts_per_text, mix, text_blocks, word_spans

# Labelled texts that a field is fitted on (lowest hash of the key), and lines of all of them together
MAX_TEXTS, MAX_LINES = 4096, 1 << 20
# Lines of a stretch that long sampled texts are cut into for the fit
STRETCH_LINES = 512
MIN_SHARE = 0.5
STEPS, RATE, DECAY = 200, 0.1, 1e-3
# Neighbouring lines of a sampled text always share their label, which would tie lines more closely than they are
MOVE_DECAY = 0.2
# Fixed value: the symbols counted as n_symbols
SYMBOLS = b"#*$%&|<>"


def text_facts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every text, and facts of every line that has a word, for one block of texts."""
    n = len(starts)
    first, last, text = word_spans(buf, ends)
    spans = SpanHash(buf)
    words = counts_per_text(text, n)
    in_word = ~byte_table((0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))[buf]

    def upto(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])

    sums = {
        "points": upto(in_word & ((buf & 0xC0) != 0x80)),
        "symbols": upto(byte_table(SYMBOLS)[buf]),
        "upper": upto((buf >= 65) & (buf <= 90)),
        "lower": upto((buf >= 97) & (buf <= 122)),
        "digits": upto((buf >= 48) & (buf <= 57)),
        "bangs": upto(buf == 33),
        "marks": upto(byte_table(b".,;:?!")[buf]),
    }
    start_flags = np.zeros(len(buf), bool)
    start_flags[first] = True
    sums["words"] = upto(start_flags)
    # words inside 3-word windows that the text has twice or more
    repeated = np.zeros(len(first), bool)
    if len(first) > 2:
        h = spans(first, last)
        three = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) + mix(text[:-2].astype(np.uint64) + np.uint64(1))
        whole = text[:-2] == text[2:]
        _, inverse, many = np.unique(three, return_inverse=True, return_counts=True)
        many = np.bincount(inverse, whole, len(many))
        again = whole & (many[inverse] >= 2)
        for shift in range(3):
            repeated[shift : len(first) - 2 + shift] |= again
    repeat_flags = np.zeros(len(buf), bool)
    repeat_flags[first[repeated]] = True
    sums["repeats"] = upto(repeat_flags)
    # lines
    breaks = np.flatnonzero(buf == 10)
    line_end = breaks
    line_start = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
    has_word = sums["words"][line_end] > sums["words"][line_start]
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_text = np.searchsorted(ends, line_start, "right")
    line_hash = spans(line_start, line_end) + mix(line_text.astype(np.uint64) + np.uint64(1))
    _, where = np.unique(line_hash, return_index=True)
    dup = np.ones(len(line_start), bool)
    dup[where] = False  # the first of equal lines
    c = {k: (v[line_end] - v[line_start]).astype(float) for k, v in sums.items()}
    tail = buf[np.maximum(line_end - 1, 0)] if len(line_end) else np.zeros(0, np.uint8)
    w, letters = np.maximum(c["words"], 1), np.maximum(c["upper"] + c["lower"], 1)
    length = c["points"] / w
    facts = np.stack(
        [
            np.ones(len(w)),
            c["words"] <= 2,
            (c["words"] > 2) & (c["words"] <= 5),
            (c["words"] > 5) & (c["words"] <= 12),
            c["words"] > 40,
            c["upper"] / letters > 0.5,
            c["upper"] / letters > 0.2,
            c["digits"] / np.maximum(c["points"], 1) > 0.2,
            c["digits"] / np.maximum(c["points"], 1) > 0.05,
            c["symbols"] / w > 0.5,
            c["symbols"] / w > 0.1,
            c["symbols"] > 0,
            c["bangs"] / w > 0.3,
            c["bangs"] > 0,
            c["marks"] / w > 0.4,
            c["marks"] == 0,
            byte_table(b".?!")[tail],
            length < 3.5,
            length > 8,
            length > 14,
            dup,
            c["repeats"] / w > 0.5,
            c["repeats"] / w > 0.2,
        ],
        axis=1,
    ).astype(np.uint8) if len(w) else np.zeros((0, 23), np.uint8)
    return {
        "n_words": words,
        "word_chars": sums["points"][ends] - sums["points"][starts],
        "n_symbols": sums["symbols"][ends] - sums["symbols"][starts],
        "n_dup_lines": counts_per_text(line_text[dup], n),
        "n_repeat_words": sums["repeats"][ends] - sums["repeats"][starts],
        "line_text": line_text,
        "line_words": c["words"].astype(np.int64),
        "facts": facts,
    }


def padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every line when sequences become rows of one matrix, longest first."""
    order = np.argsort(-lengths, kind="stable")
    row_of = np.empty(len(lengths), np.int64)
    row_of[order] = np.arange(len(lengths))
    begin = np.cumsum(lengths) - lengths
    return np.repeat(row_of, lengths), np.arange(int(lengths.sum())) - np.repeat(begin, lengths)


@dataclass
class LineField:
    """weights: (facts, 2); moves: (2, 2), from the label of a line to that of the next. Label 1 is content."""

    weights: np.ndarray
    moves: np.ndarray

    def labels(self, facts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The Viterbi labels of all lines; lengths: lines of each text."""
        lengths = np.asarray(lengths)
        if not len(facts):
            return np.zeros(0, np.int64)
        emit = facts @ self.weights
        lengths = lengths[lengths > 0]
        row, col = padded(lengths)
        line = np.lexsort((row, col))  # by column, then row
        live = np.bincount(col)
        begin = np.cumsum(live) - live
        best = emit[line[: live[0]]].copy()
        back = []
        for t in range(1, len(live)):
            at = line[begin[t] : begin[t] + live[t]]
            paths = best[: live[t], :, None] + self.moves[None]
            back.append(paths.argmax(1))
            best[: live[t]] = paths.max(1) + emit[at]
        out = np.zeros(len(facts), np.int64)
        label = best.argmax(1)
        for t in range(len(live) - 1, -1, -1):
            at = line[begin[t] : begin[t] + live[t]]
            out[at] = label[: live[t]]
            if t:
                label[: live[t]] = back[t - 1][np.arange(live[t]), label[: live[t]]]
        return out


def fit_field(sequences: list[np.ndarray], labels: list[int]) -> LineField:
    """The field of highest penalised likelihood, by gradient steps over forward and backward sums.

    All lines of a sequence carry the label of their text. Sequences above STRETCH_LINES are cut into stretches,
    between which no move is learned; memory grows with the lines. Without sequences every line counts as
    content.
    """
    if not sequences or len(set(labels)) < 2:
        only = labels[0] if sequences else 1
        weights = np.zeros((23, 2))
        weights[0, only] = 1.0
        return LineField(weights, np.zeros((2, 2)))
    facts = np.concatenate(sequences).astype(float)
    lengths = np.array([len(s) for s in sequences])
    gold = np.repeat(np.array(labels), lengths)
    n = len(lengths)
    # texts of both labels weigh the same, and long texts no more than short ones
    share = np.bincount(labels, minlength=2)
    line_weight = np.repeat(n / 2 / share[np.array(labels)] / lengths, lengths)
    # long texts in stretches: a gradient step then takes STRETCH_LINES steps along the lines at most
    lengths = np.concatenate([np.append(np.full((k - 1) // STRETCH_LINES, STRETCH_LINES), (k - 1) % STRETCH_LINES + 1) for k in lengths])
    row, col = padded(lengths)
    # first lines of all stretches, longest stretch first, then second lines, and so on
    line = np.lexsort((row, col))
    facts, gold, line_weight = facts[line], gold[line], line_weight[line]
    live = np.bincount(col)
    steps, begin = len(live), np.cumsum(live) - live
    own = [slice(begin[t], begin[t] + live[t]) for t in range(steps)]
    before = [slice(0, 0), *(slice(begin[t - 1], begin[t - 1] + live[t]) for t in range(1, steps))]
    weights, moves = np.zeros((facts.shape[1], 2)), np.zeros((2, 2))
    seen_w, seen_m = np.full(weights.shape, 1e-8), np.full(moves.shape, 1e-8)
    gold_moves = np.zeros((2, 2))
    for t in range(1, steps):
        np.add.at(gold_moves, (gold[before[t]], gold[own[t]]), line_weight[own[t]])
    for _ in range(STEPS):
        emit = facts @ weights
        forward = emit.copy()
        for t in range(1, steps):
            forward[own[t]] += np.logaddexp.reduce(forward[before[t], :, None] + moves[None], axis=1)
        chance = np.zeros((len(facts), 2))
        expected = np.zeros((2, 2))
        backward = np.zeros((live[0], 2))
        for t in range(steps - 1, -1, -1):
            k = live[t]
            joint = forward[own[t]] + backward[:k]
            total = np.logaddexp.reduce(joint, axis=1)
            chance[own[t]] = np.exp(joint - total[:, None])
            if t:
                ahead = emit[own[t]] + backward[:k]
                pair = forward[before[t], :, None] + moves[None] + ahead[:, None, :] - total[:, None, None]
                expected += (np.exp(pair) * line_weight[own[t]][:, None, None]).sum(0)
                backward[:k] = np.logaddexp.reduce(moves[None] + ahead[:, None, :], axis=2)
        wrong = chance.copy()
        wrong[np.arange(len(gold)), gold] -= 1
        gw = facts.T @ (wrong * line_weight[:, None]) / n + DECAY * weights
        gm = (expected - gold_moves) / n + MOVE_DECAY * moves
        seen_w += gw * gw
        seen_m += gm * gm
        weights -= RATE * gw / np.sqrt(seen_w)
        moves -= RATE * gm / np.sqrt(seen_m)
    return LineField(weights, moves)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, starts, ends in text_blocks(batch.column(0)):
            found = text_facts(buf, starts, ends)
            cuts = np.searchsorted(found["line_text"], np.arange(1, hi - lo))
            parts = [x.tobytes() for x in np.split(found["facts"], cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), batch.column(1)[lo:hi]], names=["facts", "label"])


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, starts, ends in text_blocks(batch.column(0)):
            lines = counts_per_text(text_facts(buf, starts, ends)["line_text"], hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(1)[lo:hi], pa.array(lines.astype(np.int64))], names=["place", "lines"])


def fit_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_texts: int = MAX_TEXTS
) -> LineField:
    """A field from at most ``max_texts`` labelled texts, chosen by a hash of their key.

    The lines of a text labelled 1 teach content, those of a text labelled 0 boilerplate. All lines of a
    text are used; texts that would bring the lines beyond MAX_LINES in all are left out. Rows without key, label or words teach nothing.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where("_key is not null and _label in (0, 1)")
    chosen = known.groupBy("_key").agg(F.min("_label").alias("_label")).orderBy(F.md5(F.col("_key").cast("string")), "_key").limit(max_texts)
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    # a repeated key counts once, so the sample is bounded whatever the table holds
    once = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_key")).groupBy("_key").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))
    sample = once.select(F.col("_text").cast("binary"), "_label", F.md5(F.col("_key").cast("string")).alias("place"))
    left, long = MAX_LINES, []
    for r in sorted(sample.select("_text", "place").mapInArrow(_line_counts, "place string, lines bigint").collect()):
        if r["lines"] > left:
            long.append(r["place"])
        else:
            left -= r["lines"]
    sample = sample.where(~F.col("place").isin(long)) if long else sample
    found = [r for r in sample.select("_text", "_label").mapInArrow(_line_rows, "facts binary, label int").collect() if r["facts"]]
    found.sort(key=lambda r: (bytes(r["facts"]), r["label"]))  # the same field whatever the order of rows
    return fit_field([np.frombuffer(r["facts"], np.uint8).reshape(-1, 23) for r in found], [r["label"] for r in found])


def rate_quality(docs: DataFrame, field: LineField, key: str = "doc_id", text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """Per document its counts, content_share, base_failed and kept; one row per row, equal keys included.

    content_share: words in content lines / words, 0 without words. base_failed: fewer than 50 words, or
    more than half of the words in repeated 3-word windows. kept: not base_failed and a content share of
    ``min_share`` at least. Null texts count as empty.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    id_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {id_type}, {', '.join(f'{c} bigint' for c in counts)}, n_content_words bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, starts, ends in text_blocks(batch.column(1)):
                found = text_facts(buf, starts, ends)
                lines = counts_per_text(found["line_text"], hi - lo)
                label = field.labels(found["facts"], lines)
                content = counts_per_text(found["line_text"], hi - lo, found["line_words"] * label)
                columns = [pa.array(found[c].astype(np.int64)) for c in counts]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *columns, pa.array(content)], names=[key, *counts, "n_content_words"])

    rated = docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = F.when(F.col("n_words") > 0, F.col("n_content_words") / F.col("n_words")).otherwise(F.lit(0.0))
    return rated.withColumn("content_share", share).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= min_share))
