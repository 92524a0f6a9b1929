"""Periodic runs, winnowing and vector codes against plain versions of themselves."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from augspark.llm import periodic_runs as pr, queries, vector_codes as vc, winnowing as wn

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- periodic runs ------------------------------------------------------------------------------


def plain_runs(words):
    """(start, length, period) of all runs, by comparing every place with every period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_extensions_of_a_grammar():
    rng = np.random.default_rng(3)
    for size in (2, 40, 700):
        for letters in (1, 2, 30):
            s = np.concatenate([[letters], rng.integers(0, letters, size), [letters + 1]])
            g = pr.recompress(s)
            m = g.mirrored()
            i, j = rng.integers(1, size + 1, (2, 300))
            i, j = i[i != j], j[i != j]
            last = len(s) - 1
            for a, b, ahead, behind in zip(i, j, g.extension(i, j), m.extension(last - i, last - j), strict=True):
                want = next(k for k in range(size + 2) if s[a + k] != s[b + k])
                back = next(k for k in range(size + 2) if s[a - k] != s[b - k])
                assert (ahead, behind) == (want, back)


def test_runs_of_random_words():
    rng = np.random.default_rng(0)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 10)):
            n, k = int(rng.integers(0, 180)), int(rng.integers(1, 5))
            w = rng.integers(0, k, n)
            if n and rng.random() < 0.7:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, 20))
                w = np.where(np.arange(n) < a, rng.integers(0, 6, n), rng.integers(0, 6, 20)[(np.arange(n) - a) % p])
                if rng.random() < 0.3:
                    w[rng.integers(0, n)] = 9
            texts.append(w)
        found = pr.find_runs(np.concatenate(texts).astype(np.int64), np.array([len(t) for t in texts]))
        want = [(t, *r) for t, w in enumerate(texts) for r in plain_runs(w.tolist())]
        assert list(zip(*(x.tolist() for x in found), strict=True)) == want


def check_runs(rows, texts):
    got = sorted((repr(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows)
    want = []
    for key, text in texts:
        words = WORD.findall(text or "")
        runs = plain_runs(words)
        want.append((repr(key), len(words), runs, plain_collapsed(words, runs)))
    assert got == sorted(want)


def test_runs_of_odd_documents(spark, odd_documents, no_documents):
    repeated = spark.createDataFrame([(50, "la " * 40 + "x\n" + "do re mi " * 9), (50, "la " * 40), (51, "Ä " * 24), (52, "a b " * 11 + "a")], "doc_id bigint, text string")
    docs = odd_documents.withColumn("runs", F.lit("clash")).unionByName(repeated, allowMissingColumns=True)
    # nothing in the odd documents is as long as their one long text, so the plain version does not try all its periods
    short = docs.where("doc_id is null or doc_id <> 23")
    check_runs(pr.periodic_runs(short).collect(), [(r["doc_id"], r["text"]) for r in short.collect()])
    long = pr.periodic_runs(docs.where("doc_id = 23")).first()
    words = WORD.findall(docs.where("doc_id = 23").first()["text"])
    for start, length, q in long["runs"]:
        stretch = words[start : start + length]
        assert stretch[q:] == stretch[:-q] and length >= max(24, 3 * q)
    assert len(long["runs"]) == 1 and long["n_words"] == len(words)
    assert pr.periodic_runs(no_documents).collect() == []
    assert pr.periodic_runs(docs, key="source").schema["source"].dataType.simpleString() == "string"


def test_runs_query(spark):
    path = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in queries.op11_recompression_runs(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    some = 0
    for key, text in docs:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(key).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = plain_runs(words) if n < 2500 else None, rows[key]
        if runs is None:
            continue
        some += len(runs)
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == sha("".join("%d,%d,%d\n" % x for x in runs))
        assert r["collapsed_sha256"] == sha(plain_collapsed(words, runs))
    assert some > 5


# -- winnowing ----------------------------------------------------------------------------------


def plain_fingerprint(text, gram=wn.GRAM, window=wn.WINDOW):
    data = text.encode()
    if not data:
        return []
    count = max(len(data) - gram + 1, 1)
    h = [zlib.crc32(data[i : i + gram]) for i in range(count)]
    chosen = {min(range(i, min(i + window, count)), key=lambda j: (h[j], -j)) for i in range(max(count - window + 1, 1))}
    return [(i, h[i]) for i in sorted(chosen)]


def plain_likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def check_edits(rows, docs):
    """docs: distinct (key, text) in order."""
    got = {(r["doc_id"], r["edited"]): r for r in rows}
    for i, (key, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = got[(key, edited)]
        own, edit = plain_fingerprint(text), plain_fingerprint(edited)
        assert r["n_chars"] == n
        assert [tuple(x) for x in r["fingerprint"]] == own and [tuple(x) for x in r["edited_fingerprint"]] == edit
        assert r["near_edited"] == pytest.approx(plain_likeness(own, edit))
        assert r["near_next"] == pytest.approx(plain_likeness(own, plain_fingerprint(after)))


def test_edits_of_documents(spark, documents):
    docs = sorted((i, t or "") for i, t, _, _ in documents)[:60]
    df = spark.createDataFrame([d for d in docs if d[1]] + [(i, None) for i, t in docs if not t], "doc_id bigint, text string").repartition(3)
    check_edits(wn.compare_with_edits(df).collect(), docs)


def test_edits_of_odd_documents(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_documents.collect()]
    found = wn.compare_with_edits(odd_documents).collect()
    assert len(found) == len(rows)
    # equal keys come in the order of a hash of their texts, which the fingerprint table gives, too
    ids = spark.createDataFrame(sorted(set(rows), key=repr), "k bigint, t string").select("k", "t", F.xxhash64("k", "t").alias("h")).collect()
    order = sorted(ids, key=lambda r: (r["k"] is None, r["k"] or 0, r["h"]))
    check_edits(found, [(r["k"], r["t"]) for r in order])
    twice = [r for r in found if r["doc_id"] == 24]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert wn.compare_with_edits(no_documents).collect() == []
    alone = wn.compare_with_edits(odd_documents.where("doc_id = 26")).collect()
    assert [(r["near_edited"], r["near_next"], r["edited"]) for r in alone] == [(0.0, 1.0, "OnO")]


def test_shared_stretches_share_a_hash(spark):
    """Any gram + window - 1 common bytes give a common choice at the same bytes, also across rows and segments of a text."""
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("abcdeé "), n))
    common = letters(wn.GRAM + wn.WINDOW - 1)
    texts = [letters(a) + common + letters(b) for a, b in ((0, 0), (5, 700), (127, 0), (1000, 40), (70_000, 70_000))]
    rows = wn.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert all([tuple(x) for x in r["fingerprint"]] == plain_fingerprint(texts[r["doc_id"]]) for r in rows)
    held = []
    for r in rows:
        data = texts[r["doc_id"]].encode()
        lo = data.index(common.encode())
        hi = lo + len(common.encode())
        held.append({data[p : p + wn.GRAM] for p, _ in r["fingerprint"] if lo <= p and p + wn.GRAM <= hi})
    assert set.intersection(*held)


# -- vector codes -------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """{row number: (code, error)} and the codebooks, all parts compared with all entries."""
    kept = [(i, k, v) for i, (k, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    width = -(-len(kept[0][2]) // parts)
    whole = {i: np.array([int(np.floor(256 * x)) for x in v] + [0] * (parts * width - len(v))).reshape(parts, width) for i, _, v in kept}
    books = [[whole[i][p] for i, _, _ in order[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((int(((x - c) ** 2).sum()), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for i in whole:
                of.setdefault(nearest(p, whole[i][p])[1], []).append(whole[i][p])
            books[p] = [np.sum(of[e], axis=0) // len(of[e]) if e in of else c for e, c in enumerate(books[p])]
    out = {}
    for i, w in whole.items():
        found = [nearest(p, w[p]) for p in range(parts)]
        out[i] = ("".join("%02x" % e for _, e in found), sum(d for d, _ in found))
    digest = sha(",".join(str(int(x)) for book in books for c in book for x in c))
    return out, digest


@pytest.mark.parametrize("entries,rounds", [(64, 2), (5, 4), (1, 2)])
def test_codes_of_clustered_vectors(spark, entries, rounds):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 0.3, (12, 32))
    values = np.concatenate([centres[rng.integers(0, 12, 400)] + rng.normal(0, 0.02, (400, 32)), rng.integers(-2, 3, (60, 32)) / 256])
    rows = [(i // 2, v) for i, v in enumerate(values.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    want, digest = plain_codes(rows, entries=entries, rounds=rounds)
    got = vc.vector_codes(df, entries=entries, rounds=rounds).collect()
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted((rows[i][0], *x) for i, x in want.items())


def test_bounds_settle_most_parts(spark):
    """Parts whose bounds hold keep their entries without comparing all, and the bounds are bounds."""
    rng = np.random.default_rng(2)
    points = rng.integers(-300, 300, (500, 16, 4))
    books = vc.Codebooks(points[:64].swapaxes(0, 1).copy())
    ids, low = vc.assign_all(points, books, 16)
    moved = books.moved_to(books.entries + rng.integers(-6, 7, books.entries.shape))
    far = lambda b: np.sqrt(((points[:, :, None] - b.entries[None]) ** 2).sum(3))
    for book, (i, bound) in ((books, (ids, low)), (moved, vc.reassign(points, ids, low, moved)[:2])):
        d = far(book)
        assert (i[:, :, 0] == d.argmin(2)).all()
        listed = np.zeros(d.shape, bool)
        for j in range(bound.shape[2]):
            np.put_along_axis(listed, i[:, :, j : j + 1].astype(int), True, 2)
            assert (np.where(listed, np.inf, d).min(2) >= bound[:, :, j]).all()
    used = vc.reassign(points, ids, low, moved)[3]
    assert 0 < used <= 16


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 20, rng.normal(0, 1, 7).round(2).tolist()) for i in range(40)]
    bad = [(1, None), (2, [0.5, None] + [0.0] * 5), (3, [float("nan")] * 7), (4, [float("inf")] + [0.0] * 6)]
    rows += [(None, [0.25] * 7), (7, [0.0] * 7), (7, [0.0] * 7)]
    schema = "vec_id bigint, embedding array<double>, label string, code string, _vector int"
    df = spark.createDataFrame([(k, v, None if (k or 0) % 3 == 0 else f"l{k % 2}", "clash", 1) for k, v in rows + bad + [(90, []), (91, [])]], schema).repartition(3)
    got = vc.with_error_per_label(vc.vector_codes(df, label="label")).collect()
    want, digest = plain_codes(rows)
    whole = [r for r in got if r["vec_id"] not in (90, 91)]
    assert sorted((repr(r["vec_id"]), r["code"], r["error"]) for r in whole) == sorted((repr(rows[i][0]), *x) for i, x in want.items())
    assert {r["codebooks_sha256"] for r in whole} == {digest}
    empty = [r for r in got if r["vec_id"] in (90, 91)]
    assert [(r["code"], r["error"], r["codebooks_sha256"]) for r in empty] == [("00" * 16, 0, sha(""))] * 2
    for label in {r["label"] for r in got}:
        assert {r["label_error"] for r in got if r["label"] == label} == {sum(r["error"] for r in got if r["label"] == label)}
    assert vc.with_error_per_label(vc.vector_codes(df.where("vec_id = 1 and embedding is null"), label="label")).collect() == []
    with pytest.raises(Exception, match="components up to"):
        vc.vector_codes(spark.createDataFrame([(1, [1e9] * 16)], "vec_id bigint, embedding array<double>")).collect()
