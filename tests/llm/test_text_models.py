"""Quality field, toxicity machine and context tree against plain versions of themselves."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from augspark.llm import context_tree as ct, quality, toxicity
from augspark.llm.arrays import text_blocks
from augspark.llm.queries import QUERIES, fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


# -- quality ------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_quality_counts(spark, odd_documents, odd_labels):
    rated = quality.rate_quality(odd_documents, quality.fit_quality(odd_documents, odd_labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter((r["doc_id"], *(r[n] for n in names)) for r in rated.collect())
    assert got == Counter((r["doc_id"], *plain_counts(r["text"])) for r in odd_documents.collect())
    for r in rated.collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        assert failed or r["kept"] == (r["content_share"] >= 0.5)


def test_quality_of_no_documents(no_documents, odd_labels, odd_documents):
    assert quality.rate_quality(no_documents, quality.fit_quality(no_documents, odd_labels)).collect() == []
    unlabelled = quality.fit_quality(odd_documents, odd_labels.where("false"))
    assert all(r["content_share"] == 1.0 for r in quality.rate_quality(odd_documents, unlabelled).where("n_words > 0").collect())


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(3)
    field = quality.LineField(rng.normal(size=(23, 2)), rng.normal(size=(2, 2)) * 2)
    lengths = [0, 5, 1, 7, 0, 3]
    facts = rng.integers(0, 2, (sum(lengths), 23)).astype(np.uint8)
    got, at = field.labels(facts, np.array(lengths)), 0
    for n in lengths:
        emit = facts[at : at + n] @ field.weights
        paths = [[(p >> i) & 1 for i in range(n)] for p in range(1 << n)]
        score = lambda p: sum(emit[i, y] for i, y in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert got[at : at + n].tolist() == (max(paths, key=score) if n else [])
        at += n


def test_field_likelihood_grows():
    """The fitted field gives the training labels a higher likelihood than one without weights."""
    rng = np.random.default_rng(4)
    labels = [i % 2 for i in range(40)]
    sequences = [np.concatenate([np.full((n, 1), 1), rng.random((n, 22)) < (0.7 if y else 0.3)], 1).astype(np.uint8) for y, n in zip(labels, rng.integers(1, 9, 40))]
    field = quality.fit_field(sequences, labels)

    def log_likelihood(f):
        total = 0.0
        for s, y in zip(sequences, labels):
            emit = s @ f.weights
            score = emit[:, y].sum() + f.moves[y, y] * (len(s) - 1)
            forward = emit[0]
            for e in emit[1:]:
                forward = e + np.logaddexp.reduce(forward[:, None] + f.moves, axis=0)
            total += score - np.logaddexp.reduce(forward)
        return total

    assert log_likelihood(field) > 0.3 * log_likelihood(quality.LineField(np.zeros((23, 2)), np.zeros((2, 2))))


def test_quality_on_held_out_labels(spark):
    """Documents that the labels call bad go, and those that they call good stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    held = quality.rate_quality(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    good = held.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = held.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.95 and bad < 0.2


def test_all_lines_of_a_sampled_text_teach(spark, monkeypatch):
    texts = [(i, "\n".join(f"line {k} of text {i} has some words" for k in range(600 + i)), i % 2) for i in range(4)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_field", lambda facts, labels: seen.append(sorted(len(f) for f in facts)))
    quality.fit_quality(docs.drop("quality"), docs.drop("text"))
    monkeypatch.setattr(quality, "MAX_LINES", 1300)
    quality.fit_quality(docs.drop("quality"), docs.drop("text"))
    assert seen[0] == [600, 601, 602, 603]
    assert len(seen[1]) == 2 and set(seen[1]) <= set(seen[0]), "fewer texts, each of them whole"


# -- toxicity -----------------------------------------------------------------------------------


def test_machine_learns_pairs():
    """Two terms that are harmless alone and toxic together, which weights alone cannot tell."""
    rng = np.random.default_rng(8)
    texts, labels = [], []
    for _ in range(3000):
        has = rng.random(2) < 0.5
        noise = 10 + rng.choice(50, 5, replace=False)
        texts.append(np.sort(np.concatenate([np.flatnonzero(has) + 1, noise])))
        labels.append(int(has.all()))
    machine = toxicity.fit_machine(texts, np.array(labels))

    def score(slots):
        known = np.array([s for s in slots if s in machine.slots])
        return machine.scores(np.zeros(len(known), int), known, 1)[0]

    assert score([1, 2]) > 0.9 and max(score([1]), score([2]), score([])) < 0.2


def test_machine_learns_pairs_of_terms_that_say_nothing_alone():
    """Each term is as toxic as chance has it; the 20 texts with both are all toxic."""
    rng = np.random.default_rng(0)
    n, texts, labels = 8192, [], []
    for i in range(n):
        pair = [1, 2] if i < 20 else [1] if i < 2000 else [2] if i < 4000 else []
        label = int(i < 20 or rng.random() < (0.04 if pair else 0.055))
        sign = [5000 + rng.integers(10)] if label and i >= 20 else []
        texts.append(np.unique([*pair, *sign, *(10 + rng.choice(3000, 30, replace=False))]))
        labels.append(label)
    order = rng.permutation(n)
    machine = toxicity.fit_machine([texts[i] for i in order], np.array(labels)[order])

    def scores(kinds):
        found = [np.unique([*kinds, *(10 + rng.choice(3000, 30, replace=False))]) for _ in range(100)]
        keep = machine.keep()
        found = [f[keep[f]] for f in found]
        return machine.scores(np.repeat(np.arange(100), [len(f) for f in found]), np.concatenate(found), 100)

    assert (scores([1, 2]) >= 0.5).mean() > 0.9
    assert max((scores([1]) >= 0.5).mean(), (scores([2]) >= 0.5).mean()) < 0.05


def test_pair_terms_against_all_pairs(monkeypatch):
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", 7)
    monkeypatch.setattr(toxicity, "PAIR_Z", 5.0)
    rng = np.random.default_rng(3)
    texts = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(400)]
    labels = np.array([int({3, 30} <= set(t.tolist()) or rng.random() < 0.05) for t in texts])
    base = labels.mean()
    wanted = set()
    for a in range(40):
        for b in range(a):
            share = [labels[[x in t for t in texts]].mean() for x in (a, b)]
            both = labels[[a in t and b in t for t in texts]]
            p = max(*share, base)
            if both.sum() >= toxicity.PAIR_TEXTS and both.sum() - len(both) * p >= toxicity.PAIR_Z * np.sqrt(len(both) * p * (1 - p)):
                wanted |= {a, b}
    text = np.repeat(np.arange(400), [len(t) for t in texts])
    assert {3, 30} <= wanted == set(toxicity.pair_terms(text, np.concatenate(texts), labels, base).tolist())


def test_machine_formula():
    rng = np.random.default_rng(9)
    m = toxicity.FactorizationMachine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    text, term = np.array([0, 0, 0, 2, 2]), np.array([1, 3, 4, 0, 5])
    for t in range(3):
        own = term[text == t]
        pairs = sum(m.vectors[a] @ m.vectors[b] for i, a in enumerate(own) for b in own[:i])
        assert m.raw(text, term, 3)[t] == pytest.approx(0.3 + m.weights[own].sum() + pairs)


def test_toxicity_of_odd_documents(odd_documents, no_documents, odd_labels):
    machine = toxicity.fit_toxicity(odd_documents, odd_labels)
    scored = toxicity.score_toxicity(odd_documents, machine)
    assert scored.columns == [*[c for c in odd_documents.columns]] and scored.count() == odd_documents.count()
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    assert toxicity.score_toxicity(no_documents, toxicity.fit_toxicity(no_documents, odd_labels)).collect() == []
    assert toxicity.fit_machine([], np.zeros(0)).scores(np.zeros(0, int), np.zeros(0, int), 2).tolist() == [0.5, 0.5]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op3_toxicity_machine"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    found = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    hit, miss, wrong = found.get((1, 1), 0), found.get((1, 0), 0), found.get((0, 1), 0)
    assert hit / (hit + miss) > 0.85 and wrong <= 0.01 * found[(0, 0)]


# -- context tree -------------------------------------------------------------------------------


def plain_tree_score(texts, train, target, depth=ct.DEPTH):
    """log10 of the chance of a text, from nested dictionaries of counts."""

    def symbols(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return " ".join(WORD.findall(lowered)).encode() + bytes([ct.END])

    counts = {}
    for t, use in zip(texts, train):
        if not use:
            continue
        data = symbols(t)
        for i, byte in enumerate(data):
            past = (bytes([ct.END]) * depth + data[:i])[-depth:][::-1]
            for d in range(depth + 1):
                node = 1
                for bit in range(7, -1, -1):
                    b = byte >> bit & 1
                    counts.setdefault((past[:d], node), [0, 0])[b] += 1
                    node = 2 * node + b

    def own(ab):
        a, b = ab
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[:-1], node), []).append((context, node))
    weighted = {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        e = own(counts[key])
        if len(key[0]) == depth:
            weighted[key] = e
        else:
            weighted[key] = math.log(0.5) + np.logaddexp(e, sum(weighted[c] for c in children[key]))
    total, data = 0.0, symbols(target)
    for i, byte in enumerate(data):
        past = (bytes([ct.END]) * depth + data[:i])[-depth:][::-1]
        node = 1
        for bit in range(7, -1, -1):
            b = byte >> bit & 1
            one, started = 0.5, False
            for d in range(depth, -1, -1):
                key = (past[:d], node)
                if key not in counts:
                    continue
                n0, n1 = counts[key]
                keep = math.exp(math.log(0.5) + own(counts[key]) - weighted[key]) if started and d < depth else 1.0
                one = keep * (n1 + 0.5) / (n0 + n1 + 1) + (1 - keep) * one
                started = True
            total += math.log10(one if b else 1 - one)
            node = 2 * node + b
    return total


def test_context_tree_against_dictionaries(spark, documents):
    rows = [(i, t[:300]) for i, (_, t, _, _) in enumerate(documents[:14])] + [(14, None), (15, ""), (16, " \n"), (17, "Zq zq ñandú ZQ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = {r["doc_id"]: r for r in ct.language_scores(df, F.col("doc_id") % 7 != 2, run_bytes=1500, buckets=5).collect()}
    texts, train = [t for _, t in rows], [i % 7 != 2 for i, _ in rows]
    counts = Counter(w for t, use in zip(texts, train) if use for w in [*WORD.findall((t or "").lower()), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        r = got[i]
        assert r["score"] == pytest.approx(plain_tree_score(texts, train, t), rel=1e-5)
        tokens = [*WORD.findall((t or "").lower()), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))


def test_chances_of_a_byte_sum_to_one(documents):
    rng = np.random.default_rng(2)
    buf = [t for _, t, _, _ in documents[:5]]
    (lo, hi, data, _, ends), *_ = text_blocks(pa.array(buf))
    plain, starts, stops, _ = ct.plain_bytes(data, ends)
    values, counts = ct.sorted_counts(ct.windows(plain, starts, stops))
    levels = ct.subtree(values, counts, top=0)
    for context in [*rng.choice(values, 5), np.uint64(0x0102030405 << 8)]:
        every = (context >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** ct.log10_chances(every, levels)).sum() == pytest.approx(1)


def test_context_tree_of_odd_documents(odd_documents, no_documents):
    scored = ct.language_scores(odd_documents, fold("doc_id", 7) != 2)
    assert scored.count() == odd_documents.count() and scored.where("score >= 0 or isnan(score)").count() == 0
    same = scored.where("doc_id = 24").select("score").distinct().count()
    assert same == 1
    assert ct.language_scores(no_documents, F.lit(True)).collect() == []
    untrained = ct.language_scores(odd_documents, F.lit(False)).where("doc_id = 21").first()
    assert untrained["score"] == pytest.approx(8 * math.log10(0.5)) and untrained["train_tokens"] == 0


def test_context_tree_beats_the_word_base(spark):
    scored = QUERIES["op8_language_context_tree"](spark, "/root/testdata/sf0.1").where("held_out")
    tree, words = scored.agg(F.sum("score"), F.sum("base_score")).first()
    assert tree > words


def test_folds():
    assert zlib.crc32(b"17") % 7 == zlib.crc32(str(17).encode()) % 7


def test_field_of_one_very_long_text(monkeypatch):
    """Memory of the fit grows with the lines, not with texts times the longest text; and the fit still tells labels apart."""
    import tracemalloc

    rng = np.random.default_rng(0)
    labels = [i % 2 for i in range(1000)] + [1]
    sequences = [rng.random((int(rng.integers(1, 20)), 23)) + np.eye(23)[y] for y in labels[:-1]] + [rng.random((50_000, 23)) + np.eye(23)[1]]
    monkeypatch.setattr(quality, "STEPS", 3)
    tracemalloc.start()
    field = quality.fit_field(sequences, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(s.nbytes for s in sequences) / 3, "about four times the facts"
    assert field.weights[0, 0] > field.weights[0, 1] and field.weights[1, 1] > field.weights[1, 0]


def test_stretches_keep_short_texts_as_they_are(monkeypatch):
    rng = np.random.default_rng(1)
    labels = [i % 2 for i in range(60)]
    sequences = [rng.random((int(rng.integers(1, 30)), 23)) for _ in labels]
    monkeypatch.setattr(quality, "STEPS", 20)
    whole = quality.fit_field(sequences, labels)
    monkeypatch.setattr(quality, "STRETCH_LINES", 30)
    same = quality.fit_field(sequences, labels)
    assert np.array_equal(whole.weights, same.weights) and np.array_equal(whole.moves, same.moves)
    monkeypatch.setattr(quality, "STRETCH_LINES", 7)
    cut = quality.fit_field(sequences, labels)
    assert np.isfinite(cut.weights).all() and np.abs(cut.weights - whole.weights).max() < 0.5
