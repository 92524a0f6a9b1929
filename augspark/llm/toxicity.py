"""Toxicity scores from a factorization machine over hashed terms.

Terms are words and the opening characters of words, hashed into 2^20 slots. A score has a weight per
term and, through a short vector per term, one for every pair of terms of a text: an insult next to a
group name may weigh more than both by themselves. The machine is fitted on a bounded sample of
labelled rows; scoring is a map over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from augspark.llm.arrays import SpanHash, lower_ascii, release_memory, text_blocks, word_spans
from augspark.llm.runs import join_parts, split_parts

SLOT_BITS = 20
# Labelled rows that a machine is fitted on: those with the lowest hash of their key
MAX_ROWS = 8192
# ... and their distinct terms per text, added up over all texts
MAX_TERMS = 1 << 24
# Terms kept by the fit: in this many labelled texts at least, and this far from chance
MIN_TEXTS, MIN_Z = 3, 4.5
# ... or with another term: both in this many toxic texts at least, and this far above the larger share of the two
PAIR_TEXTS, PAIR_Z = 8, 9.0
# Columns of the blocks in which pairs are counted
PAIR_BLOCK = 1024
FACTORS, EPOCHS, RATE, DECAY = 8, 80, 0.1, 1e-4
# Weight of a missed toxic text against a clean one called toxic; toxic texts are few
TOXIC_WEIGHT = 8.0
OPENINGS = (4, 5, 6)


def text_terms(buf: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and slot of the distinct terms of each text; ``keep``: a truth value per slot.

    A term is a lower-case word without ASCII marks at its ends, or one of its openings of 4 to 6 bytes.
    """
    buf = lower_ascii(buf)
    first, last, text = word_spans(buf, ends)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = np.ones(256, bool)
    mark[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
    for _ in range(4):
        last = np.where((last > first + 1) & mark[buf[last - 1]], last - 1, last)
        first = np.where((last > first + 1) & mark[buf[first]], first + 1, first)
    spans = SpanHash(buf)
    shift = np.uint64(64 - SLOT_BITS)
    texts, slots = [], []
    for size in (0, *OPENINGS):
        long = np.ones(len(first), bool) if size == 0 else last - first > size
        at = (spans(first[long], last[long] if size == 0 else first[long] + size) ^ np.uint64(size * 0x9E3779B9)) >> shift
        at = at.astype(np.int64)
        of = text[long]
        if keep is not None:
            at, of = at[keep[at]], of[keep[at]]
        texts.append(of)
        slots.append(at)
    pairs = np.unique((np.concatenate(texts) << SLOT_BITS) | np.concatenate(slots))
    return pairs >> SLOT_BITS, pairs & ((1 << SLOT_BITS) - 1)


@dataclass
class FactorizationMachine:
    """bias + sum of weights + sum over pairs of the products of their vectors, through the logistic function."""

    slots: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic function; text and term: number of the text and of the known term."""
        out = self.bias + np.bincount(text, self.weights[term], n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[term, f]
            out += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return out

    def scores(self, text: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        return logistic(self.raw(text, np.searchsorted(self.slots, slot), n))

    def to_bytes(self) -> bytes:
        parts = [self.slots.astype("<i8"), np.array([self.bias]), self.weights, self.vectors]
        return join_parts([np.ascontiguousarray(x).tobytes() for x in parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> FactorizationMachine:
        slots, bias, weights, vectors = split_parts(data)
        slots = np.frombuffer(slots, "<i8")
        return cls(slots, float(np.frombuffer(bias)[0]), np.frombuffer(weights), np.frombuffer(vectors).reshape(len(slots), FACTORS))

    def keep(self) -> np.ndarray:
        known = np.zeros(1 << SLOT_BITS, bool)
        known[self.slots] = True
        return known


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pair_terms(text: np.ndarray, slot: np.ndarray, labels: np.ndarray, base: float) -> np.ndarray:
    """Slots that stand in some pair which is toxic more often than either of its terms makes likely.

    All pairs of terms in PAIR_TEXTS toxic texts are counted, over all texts; equal texts count once.
    """
    n = len(labels)
    is_toxic = labels == 1
    seen = np.bincount(slot, minlength=1 << SLOT_BITS)
    toxic = np.bincount(slot[is_toxic[text]], minlength=1 << SLOT_BITS)
    good = np.flatnonzero(toxic >= PAIR_TEXTS)
    share = np.maximum(toxic[good] / seen[good], base).astype(np.float32)
    at = np.full(1 << SLOT_BITS, -1, np.int32)
    at[good] = np.arange(len(good))
    term = at[slot]
    text, term = text[term >= 0], term[term >= 0]
    order = np.argsort(term, kind="stable")
    text, term = text[order], term[order]
    cuts = np.arange(0, len(good) + PAIR_BLOCK, PAIR_BLOCK)
    bounds = np.searchsorted(term, cuts)

    def block(i: int) -> np.ndarray:
        has = np.zeros((n, min(cuts[i + 1], len(good)) - cuts[i]), np.float32)
        has[text[bounds[i] : bounds[i + 1]], term[bounds[i] : bounds[i + 1]] - cuts[i]] = 1
        return has

    found = np.zeros(len(good), bool)
    for i in range(len(cuts) - 1):
        one = block(i)
        for j in range(i, len(cuts) - 1):
            other = one if j == i else block(j)
            hits = one[is_toxic].T @ other[is_toxic]
            a, b = np.nonzero(hits >= PAIR_TEXTS)
            if not len(a):
                continue
            hit, both = hits[a, b], (one.T @ other)[a, b]
            p = np.minimum(np.maximum(share[cuts[i] + a], share[cuts[j] + b]), 1 - 1e-6)
            far = (hit - both * p >= PAIR_Z * np.sqrt(both * p * (1 - p))) & (cuts[i] + a != cuts[j] + b)
            found[cuts[i] + a[far]] = True
            found[cuts[j] + b[far]] = True
    return good[found]


def fit_machine(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """Fits on texts given as arrays of distinct slots, with labels 0 and 1, by adaptive gradient steps.

    Terms are those that tell the labels apart alone, and those that do so in a pair only. Without any
    (one label only, no rows) the score is the share of label 1.
    """
    n = len(texts)
    labels = np.asarray(labels, float)
    base = (labels.sum() + 0.5) / (n + 1)
    text = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in texts])
    slot = np.concatenate(texts) if n else np.zeros(0, np.int32)
    seen = np.bincount(slot, minlength=1 << SLOT_BITS)
    toxic = np.bincount(slot[(labels == 1)[text]], minlength=1 << SLOT_BITS)
    expected = seen * base
    z = (toxic - expected) / np.sqrt(np.maximum(expected * (1 - base), 1e-9))
    chosen = (seen >= MIN_TEXTS) & (np.abs(z) >= MIN_Z)
    once = np.zeros(n, bool)  # copies of a text say nothing about its pairs
    once[list({t.tobytes(): i for i, t in enumerate(texts)}.values())] = True
    own = once[text]
    if own.any():
        chosen[pair_terms((np.cumsum(once) - 1)[text[own]], slot[own], labels[once], base)] = True
    good = np.flatnonzero(chosen)
    inside = chosen[slot]
    text, term = text[inside].astype(np.int64), np.searchsorted(good, slot[inside])
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(good, float(np.log(base / (1 - base))), np.zeros(len(good)), rng.normal(0, 0.05, (len(good), FACTORS)))
    if not len(good):
        return m
    bounds = np.searchsorted(text, np.arange(0, n + 256, 256))
    past = [1e-6, np.full(len(good), 1e-6), np.full(m.vectors.shape, 1e-6)]
    for _ in range(EPOCHS):
        for b in rng.permutation(len(bounds) - 1):
            lo, hi = bounds[b], bounds[b + 1]
            rows = np.arange(b * 256, min(n, b * 256 + 256))
            if not len(rows):
                continue
            t, k = text[lo:hi] - b * 256, term[lo:hi]
            error = (logistic(m.raw(t, k, len(rows))) - labels[rows]) * np.where(labels[rows] == 1, TOXIC_WEIGHT, 1.0)
            g = error.mean()
            past[0] += g * g
            m.bias -= RATE * g / np.sqrt(past[0])
            gw = np.bincount(k, error[t], len(good)) / len(rows) + DECAY * m.weights
            past[1] += gw * gw
            m.weights -= RATE * gw / np.sqrt(past[1])
            for f in range(FACTORS):
                v = m.vectors[k, f]
                sums = np.bincount(t, v, len(rows))
                gv = np.bincount(k, error[t] * (sums[t] - v), len(good)) / len(rows) + DECAY * m.vectors[:, f]
                past[2][:, f] += gv * gv
                m.vectors[:, f] -= 0.3 * RATE * gv / np.sqrt(past[2][:, f])
    return m


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, _, ends in text_blocks(batch.column(0)):
            text, slot = text_terms(buf, ends)
            cuts = np.searchsorted(text, np.arange(1, hi - lo))
            parts = [x.astype("<i4").tobytes() for x in np.split(slot, cuts)]
            columns = [pa.array(parts, pa.binary()), batch.column(1)[lo:hi], batch.column(2)[lo:hi]]
            yield pa.RecordBatch.from_arrays(columns, names=["slots", "label", "place"])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = MAX_ROWS,
    max_terms: int = MAX_TERMS,
) -> FactorizationMachine:
    """A machine from at most ``max_rows`` labelled rows, chosen by a hash of their key.

    usable: which keys may be learned from. Rows without a key, text or label teach nothing. Of long texts
    fewer are taken: those whose terms, added up in the order of the hash, reach ``max_terms`` end the sample.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where("_key is not null and _label in (0, 1)")
    if usable is not None:
        known = known.where(usable)
    chosen = known.groupBy("_key").agg(F.max("_label").alias("_label")).orderBy(F.md5(F.col("_key").cast("string")), "_key").limit(max_rows)
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).where("_text is not null")
    # a repeated key counts once, so the sample is bounded whatever the table holds
    once = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_key")).groupBy("_key").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    sample = once.select(F.col("_text").cast("binary"), "_label", F.md5(F.col("_key").cast("string")))
    slots = sample.mapInArrow(_slots_of, "slots binary, label int, place string")

    def fit(table: pa.Table) -> pa.Table:
        # the same machine whatever the order of rows
        table = table.sort_by([("place", "ascending"), ("slots", "ascending")])
        texts = [np.frombuffer(x, "<i4") for x in table.column("slots").to_pylist()]
        inside = np.cumsum([len(t) for t in texts]) <= max_terms
        texts = [t for t, good in zip(texts, inside, strict=True) if good]
        machine = fit_machine(texts, table.column("label").to_numpy()[: len(texts)])
        release_memory()
        return pa.table({"machine": pa.array([machine.to_bytes()], pa.binary())})

    # one task fits the sample, which is bounded by rows and by terms; only the machine comes to the driver
    fitted = slots.groupBy(F.lit("all").alias("_all")).applyInArrow(fit, "machine binary").first()
    return FactorizationMachine.from_bytes(bytes(fitted["machine"])) if fitted else fit_machine([], np.zeros(0))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of the documents and a score from 0 to 1; null and empty texts get the score of a text without terms.

    A column called ``name`` is replaced.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keep = machine.keep()
        for texts in batches:
            out = np.zeros(len(texts))
            for lo, hi, buf, _, ends in text_blocks(pa.array(texts, pa.binary(), from_pandas=True)):
                of, slot = text_terms(buf, ends, keep)
                out[lo:hi] = machine.scores(of, slot, hi - lo)
            yield pd.Series(out)

    return docs.withColumn(name, score(F.col(text).cast("binary")))
