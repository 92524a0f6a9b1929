"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A string of LENGTH bytes is removed if it starts earlier as well. Not every suffix is sorted: in every
window of LENGTH bytes the part of half that length with the lowest hash is its anchor, and equal windows
have equal anchors at the same place. Neighbouring windows with one anchor form one entry, a suffix that
starts at the anchor together with the few bytes before it. Anchors that the corpus has once are left
out, as nothing can be equal there.

1. Runs of documents count their anchors; buckets of anchors tell each run which of its anchors repeat.
2. A run sorts its entries and sends each bucket a front-coded run: the length of the prefix shared with
   the entry before, and the rest. Of equal entries in a run only the first is sent; the others are
   removed for certain.
3. A bucket merges its runs with a loser tree that compares lengths of known prefixes first and looks at
   bytes only behind them. Entries that share an anchor come out side by side, with the shared length.
4. Among those, windows are compared byte by byte; all but the earliest are removed.

An anchor in more than HOT entries would fill one bucket. Its windows are sent one by one, to buckets
chosen by the whole window; equal windows still meet, and a run sends each of them once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from augspark.llm.arrays import SpanHash, mix, text_blocks
from augspark.llm.runs import RUN_BYTES, dealt_into_runs, join_parts, pack_sorted, run_count, sorted_counts, split_parts, unpack_sorted

LENGTH = 100
HOT = 1000
# Entries with one anchor that are compared pair by pair; more are compared by a set of their windows
PAIRWISE = 6


def anchored(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Entries of a block as (first window, last window, anchor, hash of the anchor, text), by place."""
    part = length // 2
    reach = length - part + 1  # anchors a window can have
    m = len(buf) - part + 1
    none = np.zeros(0, np.int64)
    if m < reach:
        return none, none, none, np.zeros(0, np.uint64), none
    fits = ends - starts >= length
    if not fits.any():
        return none, none, none, np.zeros(0, np.uint64), none
    raw = SpanHash(buf).all_of_size(part)
    bits = np.uint64(int(len(buf)).bit_length())
    # the lowest hash, the leftmost of equal ones
    low = raw * np.uint64(0x9E3779B97F4A7C15)
    low >>= bits
    low <<= bits
    low |= np.arange(m, dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    text = np.searchsorted(ends, change, "right")
    inside = (change > starts[text]) & (change <= ends[text] - length)
    lo = np.concatenate([starts[fits], change[inside]])
    text = np.concatenate([np.flatnonzero(fits), text[inside]])
    order = np.argsort(lo)
    lo, text = lo[order], text[order]
    hi = np.append(lo[1:] - 1, 0)
    final = np.append(text[1:] != text[:-1], True)
    hi[final] = ends[text[final]] - length
    p = (low[lo] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return lo, hi, p, mix(raw[p]), text


def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A run's rows by key (null last), hash of the text and text, with keys and hashes as numbers."""
    data = table.column("data")
    key = np.array([k if k is not None else 2**63 - 1 for k in table.column("key").to_pylist()], np.int64)
    mark = np.array(table.column("mark").to_pylist(), np.int64)
    order = np.lexsort((mark, key))
    k, h = key[order], mark[order]
    for same in np.flatnonzero((k[1:] == k[:-1]) & (h[1:] == h[:-1])):  # equal rows, or a chance collision
        a, b = order[same], order[same + 1]
        if data[int(a)].as_py() > data[int(b)].as_py():
            order[same], order[same + 1] = b, a
    return table.take(pa.array(order)), key[order], mark[order]


def _texts(table: pa.Table) -> pa.Array:
    column = pc.fill_null(table.column("data"), b"").combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted suffixes: length shared with the one before, length of the rest, all rests."""
    n = len(suffixes)
    size = np.fromiter(map(len, suffixes), np.int64, n)
    wide = int(size.max()) if n else 0
    flat = np.frombuffer(b"".join(suffixes), np.uint8)
    shared = np.zeros(n, np.int64)
    begin = np.cumsum(size) - size
    for a in range(0, n, 20_000):  # bounds the matrix
        b = min(n, a + 20_000)
        lead = max(0, a - 1)
        column = np.arange(wide)
        inside = column < size[lead:b, None]
        matrix = np.zeros((b - lead, wide), np.int16) - 1
        matrix[inside] = flat[begin[lead] : begin[b - 1] + size[b - 1]]
        differs = matrix[1:] != matrix[:-1]
        lcp = np.where(differs.any(1), differs.argmax(1), size[lead + 1 : b])
        shared[lead + 1 : b] = lcp
    rest = b"".join([s[k:] for s, k in zip(suffixes, shared.tolist(), strict=True)])
    return shared, size - shared, rest


def decoded(shared: np.ndarray, rest_size: np.ndarray, rest: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for k, n in zip(shared.tolist(), rest_size.tolist(), strict=True):
        before = before[:k] + rest[at : at + n]
        at += n
        out.append(before)
    return out


def _compare(a: bytes, b: bytes, known: int) -> tuple[bool, int]:
    """Whether a <= b, and their shared length; the first ``known`` bytes are equal and not looked at."""
    x, y = a[known:], b[known:]
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return len(x) <= len(y), known + n
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return x < y, known + n - (differ.bit_length() + 7) // 8


def merged(runs: list[list[bytes]], shared: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """The merge of sorted runs as (run, place in the run, length shared with the suffix before).

    A loser tree: every inner node holds the loser of a match and how much it shares with the winner. A
    new suffix of the winning run knows how much it shares with the last output from its front coding.
    On the way up more shared bytes mean the smaller suffix; bytes are read only behind equal lengths.
    """
    live = [i for i, r in enumerate(runs) if r]
    width = 1
    while width < len(live):
        width *= 2
    place = [0] * len(runs)
    loser: list[tuple[int, int]] = [(-1, -1)] * width  # (run, shared); run -1 is past all suffixes

    def play(a: int, ka: int, b: int, kb: int) -> tuple[int, int, int, int]:
        """Winner and its shared length, loser and its shared length with the winner."""
        if ka != kb:
            return (a, ka, b, kb) if ka > kb else (b, kb, a, ka)
        if a < 0 or b < 0:
            return (a, ka, b, kb) if b < 0 else (b, kb, a, ka)
        first, known = _compare(runs[a][place[a]], runs[b][place[b]], ka)
        return (a, ka, b, known) if first else (b, ka, a, known)

    def build(node: int) -> tuple[int, int]:
        if node >= width:
            i = node - width
            return (live[i], 0) if i < len(live) else (-1, -1)
        (a, ka), (b, kb) = build(2 * node), build(2 * node + 1)
        w, kw, x, kx = play(a, ka, b, kb)
        loser[node] = (x, kx)
        return w, kw

    leaf = {r: i + width for i, r in enumerate(live)}
    run, known = build(1) if live else (-1, -1)
    while run >= 0:
        yield run, place[run], known
        place[run] += 1
        node = leaf[run] >> 1
        mine = runs[run]
        if place[run] < len(mine):
            known = shared[run][place[run]]
        else:
            run, known = -1, -1
        while node:
            other, k = loser[node]
            if k > known:
                loser[node] = (run, known)
                run, known = other, k
            elif k == known and other >= 0:
                run, known, x, kx = play(run, known, other, k)
                loser[node] = (x, kx)
            node >>= 1


def _shared_end(a: bytes, b: bytes) -> int:
    """How many of their last bytes are equal."""
    n = min(len(a), len(b))
    if n == 0:
        return 0
    x, y = a[len(a) - n :], b[len(b) - n :]
    if x == y:
        return n
    differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
    return n - (differ.bit_length() + 7) // 8


def _scan(table: pa.Table, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    for lo, _, buf, starts, ends in text_blocks(_texts(table)):
        yield lo, buf, starts, anchored(buf, starts, ends, length)


def _entries(found, length: int, repeated: np.ndarray, hot: np.ndarray, buckets: int):
    """A run's entries by bucket, and the windows that repeat earlier ones of the run."""
    sent: dict[int, list[tuple[bytes, bytes, int, int]]] = {}
    seen: set[bytes] = set()
    dropped: list[tuple[int, int, int]] = []
    for row0, buf, starts, (lo, hi, p, h, text) in found:
        if not len(repeated):
            continue
        at = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
        chosen = np.flatnonzero(repeated[at] == h)
        if not len(chosen):
            continue
        is_hot = hot[at[chosen]].tolist()
        to = (h[chosen] % np.uint64(buckets)).astype(np.int64).tolist()
        place = (lo - starts[text])[chosen].tolist()
        row = (row0 + text)[chosen].tolist()
        view = buf.tobytes()
        for a, z, q, r, w, b, warm in zip(lo[chosen].tolist(), hi[chosen].tolist(), p[chosen].tolist(), row, place, to, is_hot, strict=True):
            whole = view[a : z + length]
            if whole in seen:
                dropped.append((r, w, z - a + 1))
                continue
            seen.add(whole)
            if not warm:
                sent.setdefault(b, []).append((whole[q - a :], whole[: q - a], r, w))
                continue
            for i in range(z - a + 1):
                one = whole[i : i + length]
                if z > a:
                    if one in seen:
                        dropped.append((r, w + i, 1))
                        continue
                    seen.add(one)
                sent.setdefault(_spread(one, buckets), []).append((one, b"", r, w + i))
    return sent, dropped


def _spread(window: bytes, buckets: int) -> int:
    import zlib

    return zlib.crc32(window) % buckets


def _coded(entries: list[tuple[bytes, bytes, int, int]], key: np.ndarray, mark: np.ndarray) -> bytes:
    entries.sort()
    shared, rest_size, rest = front_coded([e[0] for e in entries])
    rows = np.array([e[2] for e in entries], np.int64)
    parts = [
        shared.astype("<u2").tobytes(),
        rest_size.astype("<u2").tobytes(),
        rest,
        np.array([len(e[1]) for e in entries], "<u2").tobytes(),
        b"".join([e[1] for e in entries]),
        rows.astype("<u4").tobytes(),
        np.array([e[3] for e in entries], "<u4").tobytes(),
        key[rows].astype("<i8").tobytes(),
        mark[rows].astype("<i8").tobytes(),
    ]
    return join_parts(parts)


def _dropped_bytes(dropped: list[tuple[int, int, int]]) -> bytes:
    return np.array(dropped, "<u4").reshape(-1, 3).tobytes()


def repeated_windows(messages: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, list[tuple[int, int, int]]]:
    """Of one bucket's front-coded runs: per run the windows (row, place, count) that occur earlier somewhere."""
    part = length // 2
    runs, shared, details = [], [], []
    for _, data in messages:
        k, n, rest, left_size, lefts, rows, places, keys, marks = split_parts(data)
        k = np.frombuffer(k, "<u2")
        runs.append(decoded(k, np.frombuffer(n, "<u2"), rest))
        shared.append(k.tolist())
        size = np.frombuffer(left_size, "<u2").astype(np.int64)
        cuts = np.cumsum(size)
        left = [lefts[a:b] for a, b in zip((cuts - size).tolist(), cuts.tolist(), strict=True)]
        numbers = (np.frombuffer(x, t).tolist() for x, t in ((keys, "<i8"), (marks, "<i8"), (rows, "<u4"), (places, "<u4")))
        details.append(list(zip(left, *numbers, strict=True)))
    out: dict[int, list[tuple[int, int, int]]] = {}

    def settle(group: list[tuple[int, int, int]]) -> None:
        if len(group) > PAIRWISE:
            return settle_many(group)
        # shared bytes to the right of the anchor are known from the merge
        for b in range(len(group)):
            known = length
            for a in range(b - 1, -1, -1):
                known = min(known, group[a + 1][2])
                one, two = group[a], group[b]
                x, y = details[one[0]][one[1]], details[two[0]][two[1]]
                first_x = (x[1], x[2], messages[one[0]][0], x[3], x[4]) < (y[1], y[2], messages[two[0]][0], y[3], y[4])
                s, i = (two[0], two[1]) if first_x else (one[0], one[1])
                later = y if first_x else x
                shared_left = _shared_end(x[0], y[0])
                size = len(later[0])
                from_, to = size - shared_left, min(size + len(runs[s][i]) - length, size - length + known)
                if from_ <= to:
                    out.setdefault(messages[s][0], []).append((later[3], later[4] + from_, to - from_ + 1))

    def settle_many(group: list[tuple[int, int, int]]) -> None:
        members = sorted(
            (details[s][i][1], details[s][i][2], messages[s][0], details[s][i][3], details[s][i][4], details[s][i][0] + runs[s][i])
            for s, i, _ in group
        )
        seen: set[bytes] = set()
        for _, _, run, row, place, whole in members:
            count = len(whole) - length + 1
            if whole in seen:
                out.setdefault(run, []).append((row, place, count))
                continue
            seen.add(whole)
            if count == 1:
                continue
            again = -1
            for i in range(count + 1):
                one = whole[i : i + length] if i < count else None
                if one is not None and one in seen:
                    again = i if again < 0 else again
                    continue
                if one is not None:
                    seen.add(one)
                if again >= 0:
                    out.setdefault(run, []).append((row, place + again, i - again))
                    again = -1

    group: list[tuple[int, int, int]] = []
    for s, i, known in merged(runs, shared):
        if known < part and group:
            if len(group) > 1:
                settle(group)
            group = []
        group.append((s, i, known))
    if len(group) > 1:
        settle(group)
    return out


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
    length: int = LENGTH,
    run_bytes: int = RUN_BYTES,
    hot: int = HOT,
    as_text: bool = False,
) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept (binary), and a struct ``carried`` of the named columns.

    as_text: kept is a string; a character that lost some of its bytes goes as a whole.

    A byte goes if a ``length``-byte string that covers it also starts earlier: in a row with a smaller key,
    or in the same row further left. Null keys come last; rows with equal keys are ordered by a hash of
    their text and the text. Null texts count as empty, texts shorter than ``length`` stay whole. Keys are
    whole numbers. An empty table gives an empty result.
    """
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("string").alias("none"))
    whole = docs.select(F.col(key).cast("bigint").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), carried.alias("_carried"))
    runs = run_count(whole, "_text", run_bytes)
    buckets = max(12, min(2 * runs, 1024))
    dealt = dealt_into_runs(whole, runs, "_key", "_text", [F.xxhash64("_text").alias("mark"), F.col("_carried").alias("carried")])

    def ask(run: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [sorted_counts(e[3]) for _, _, _, e in _scan(table, length)]
        values, counts = sorted_counts(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        to = (values % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        parts = [(b, order[cuts[b] : cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts)).tolist()]
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in parts], pa.int32()),
                "run": pa.array([run[0].as_py()] * len(parts), pa.int32()),
                "anchors": pa.array([pack_sorted(values[i]) for _, i in parts], pa.binary()),
                "counts": pa.array([counts[i].astype("<u4").tobytes() for _, i in parts], pa.binary()),
            }
        )

    def tell(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asked = [unpack_sorted(a) for a in table.column("anchors").to_pylist()]
        counts = [np.frombuffer(c, "<u4").astype(np.int64) for c in table.column("counts").to_pylist()]
        values, total = sorted_counts(np.concatenate(asked), np.concatenate(counts))
        anchors, warm = [], []
        for a in asked:
            n = total[np.searchsorted(values, a)]
            anchors.append(a[n > 1].tobytes())
            warm.append((n[n > 1] > hot).tobytes())
        return pa.table({"run": table.column("run"), "anchors": pa.array(anchors, pa.binary()), "warm": pa.array(warm, pa.binary())})

    def send(run: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        table, keys, marks = in_order(table)
        anchors = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(a, np.uint64) for a in told.column("anchors").to_pylist())])
        warm = np.concatenate([np.zeros(0, bool), *(np.frombuffer(w, bool) for w in told.column("warm").to_pylist())])
        order = np.argsort(anchors)
        sent, dropped = _entries(_scan(table, length), length, anchors[order], warm[order], buckets)
        number = run[0].as_py() if table.num_rows else 0
        rows = [(b, number, _coded(e, keys, marks), None) for b, e in sorted(sent.items())]
        if dropped:
            rows.append((number % buckets, number, None, _dropped_bytes(dropped)))
        types = {"bucket": pa.int32(), "run": pa.int32(), "suffixes": pa.binary(), "dropped": pa.binary()}
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(types.items())})

    def merge(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("run").to_pylist(), table.column("suffixes").to_pylist(), table.column("dropped").to_pylist(), strict=True))
        out = [(run, dropped) for run, _, dropped in rows if dropped is not None]
        found = repeated_windows(sorted((run, data) for run, data, _ in rows if data is not None), length)
        out += [(run, _dropped_bytes(d)) for run, d in found.items()]
        return pa.table({"run": pa.array([r[0] for r in out], pa.int32()), "dropped": pa.array([r[1] for r in out], pa.binary())})

    def cut(run: tuple[pa.Scalar, ...], table: pa.Table, gone: pa.Table) -> pa.Table:
        table, _, _ = in_order(table)
        parts = [np.frombuffer(d, "<u4").reshape(-1, 3) for d in gone.column("dropped").to_pylist()]
        row, place, count = np.concatenate([np.zeros((0, 3), "<u4"), *parts]).astype(np.int64).T
        n = table.num_rows
        removed, spans, size, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for lo, hi, buf, starts, ends in text_blocks(_texts(table)):
            mine = (row >= lo) & (row < hi)
            begin = starts[row[mine] - lo] + place[mine]
            change = np.zeros(len(buf) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + count[mine] - 1 + length, -1)
            cover = np.cumsum(change[:-1]) > 0
            upto = np.concatenate([[0], np.cumsum(cover)])
            edge = np.concatenate([[0], np.cumsum(cover & ~np.concatenate([[False], cover[:-1]]))])
            size[lo:hi], removed[lo:hi], spans[lo:hi] = ends - starts, upto[ends] - upto[starts], edge[ends] - edge[starts]
            data, left = buf[~cover].tobytes(), np.concatenate([[0], np.cumsum(~cover)])
            parts_left = [data[a:b] for a, b in zip(left[starts].tolist(), left[ends].tolist(), strict=True)]
            kept += [p.decode("utf-8", "ignore") for p in parts_left] if as_text else parts_left
        return pa.table(
            {
                "key": table.column("key"),
                "n_bytes": pa.array(size),
                "n_removed": pa.array(removed),
                "n_spans": pa.array(spans),
                "kept": pa.array(kept, pa.string() if as_text else pa.binary()),
                "carried": table.column("carried"),
            }
        )

    asked = dealt.groupBy("run").applyInArrow(ask, "bucket int, run int, anchors binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(tell, "run int, anchors binary, warm binary")
    sent = dealt.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(send, "bucket int, run int, suffixes binary, dropped binary")
    gone = sent.groupBy("bucket").applyInArrow(merge, "run int, dropped binary")
    kind = dealt.schema["carried"].dataType.simpleString()
    result = dealt.groupBy("run").cogroup(gone.groupBy("run")).applyInArrow(
        cut, f"key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if as_text else 'binary'}, carried {kind}"
    )
    return result.withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with what is left of their texts, all columns as given; n_chars, if there, follows the text.

    A character that lost some of its bytes goes as a whole.
    """
    names = [f"`{c}`" for c in docs.columns]
    places = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text}
    numbered = docs.select(*[F.col(n).alias(places.get(c, "_body")) for n, c in zip(names, docs.columns, strict=True)])
    keyed = numbered.withColumn("_key", F.col(places[key]))
    left = remove_repeats(keyed, "_key", "_body", list(places.values()), as_text=True, **options)
    out = left.select(F.col("kept").alias("_body"), "carried.*")
    out = out.select(*[F.col(places.get(c, "_body")).alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out
