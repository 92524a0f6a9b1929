"""Packing, mixing, SimHash, suffix dedup and the pipeline against plain versions of themselves."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from augspark.llm import components, mixing, packing, simhash, suffix_dedup as sd
from augspark.llm.arrays import text_blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- packing ------------------------------------------------------------------------------------


def check_packing(pieces, docs, tokenizer_file, window=packing.WINDOW):
    """Every token once, windows without gaps, right checksums; returns the tokens per window and source."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    wanted = Counter()
    for key, text, source in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        wanted[(key, source, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    rows = pieces.collect()
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append(r)
    assert sorted(windows) == list(range(len(windows)))
    for number, own in windows.items():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()
        size = sum(r["length"] for r in own)
        assert size == window or number == len(windows) - 1
        assert {r["padded_to"] for r in own} == {size if size & (size - 1) == 0 else window}
    for r in rows:
        assert r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    got = Counter()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        by_doc.setdefault((r["doc_id"], r["source"], r["doc_tokens"]), {}).setdefault(r["start"], []).append(r)
    for (key, source, n), starts in by_doc.items():
        copies = len(starts[0])
        for c in range(copies):  # repeated rows are cut each in its own way
            at, data = 0, b""
            while at < n:
                piece = starts[at].pop()
                data += piece["ids"]
                at += piece["length"]
            got[(key, source, n, zlib.crc32(data))] += 1
    assert got == wanted
    return {k: Counter() + sum((Counter({r["source"]: r["length"]}) for r in v), Counter()) for k, v in windows.items()}


def test_packing_fills_windows_to_the_mixture(spark, documents, tokenizer_file):
    df = spark.createDataFrame([(i, t, s) for i, t, _, s in documents], "doc_id bigint, text string, source string").repartition(5)
    pieces = packing.pack(df, tokenizer_file, window=256, with_ids=True).cache()
    mix = check_packing(pieces, [(i, t, s) for i, t, _, s in documents], tokenizer_file, 256)
    totals = sum(mix.values(), Counter())
    for t, own in mix.items():
        if t < len(mix) - 1:
            assert all(abs(own[s] - 256 * n / sum(totals.values())) <= 3 for s, n in totals.items())
    whole = packing.sequences(pieces)
    assert whole.where("length(ids) <> 4 * n_tokens").count() == 0 and whole.count() == len(mix)


def test_packing_of_odd_documents(spark, odd_documents, no_documents, tokenizer_file):
    # pieces of rows with one key and different texts cannot be told apart, so keys are made unique here
    rows = [(i, r["text"], r["source"]) for i, r in enumerate(odd_documents.collect())]
    rows[3] = (3, "<|endoftext|> It's, (é) ö! 12. ÷. ​ x y ...! K̊ <|STARTOFTEXT|> á, don't. _ ...,", None)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("ids", F.lit("clash"))
    check_packing(packing.pack(df, tokenizer_file, with_ids=True), rows, tokenizer_file)
    assert packing.pack(no_documents, tokenizer_file).collect() == []
    repeated = packing.pack(odd_documents, tokenizer_file).groupBy().agg(F.sum("length"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens")))).first()
    assert repeated[0] == repeated[1]


@pytest.mark.parametrize("weights", [None, [5, 2, 1, 0], [1, 1, 1, 1]])
def test_schedule_carries_deficits(weights):
    totals = [300_000, 7, 40_000, 1234]
    s = packing.Schedule(totals, weights, window=64)
    blocks = [s.block(b) for b in range(s.blocks)]
    assert all((a[-1] == b[0]).all() for a, b in zip(blocks, blocks[1:]))
    rows = np.concatenate([np.diff(b, axis=0) for b in blocks])
    assert (rows >= 0).all() and (rows[:-1].sum(1) == 64).all() and rows.sum(0).tolist() == totals
    cumulative, at = np.cumsum(rows, axis=0), 0
    for t, c in enumerate(cumulative[:-1]):
        assert np.abs(s.ideal((t + 1) * 64) - c).max() <= 2, "what a source is owed never adds up"
    for b in range(0, s.blocks, 7):
        for source in range(4):
            if blocks[b][-1, source] > blocks[b][0, source]:
                assert s.find_block(source, int(blocks[b][0, source])) == b


# -- mixing -------------------------------------------------------------------------------------


def plain_mix(rows):
    """(size, source, target, taken) per row, by sorting the documents of each source."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, sum(total.values()), set(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        for s in over or open_:
            target[s] = 3.0 * total[s] if over else share[s]
        open_ -= set(over) if over else open_
        left -= sum(3 * total[s] for s in over)
    out = []
    for s in sources:
        epochs = int(target[s] // total[s]) if total[s] else 0
        budget = int(target[s] - epochs * total[s])
        place = lambda k: hashlib.md5(f"mix:{'null' if k is None else k}".encode()).hexdigest()[:15]
        own = sorted((place(k), n, k) for n, (k, _, x) in zip(size, rows) if x == s)
        upto = Counter()
        for p, n, _ in own:
            upto[p] += n
        running, fits = 0, set()
        for p in sorted(upto):
            running += upto[p]
            if 2 * running - upto[p] < 2 * budget:
                fits.add(p)
        out += [(k, n, total[s], target[s], n * (epochs + (p in fits))) for p, n, k in own]
    return out


def same_mix(df, rows):
    got = [tuple(r) for r in mixing.mix_sources(df).select("doc_id", "size", "source_size", "target", "taken").collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    for a, b in zip(sorted(got, key=key), sorted(plain_mix(rows), key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4]


def test_mix_against_sorting(spark, documents):
    rows = [(i, t, s) for i, t, _, s in documents]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    same_mix(df, rows)
    taken = mixing.mix_sources(df).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["n"] - r["target"]) <= r["most"] / 2 + 1 for r in taken)


def test_mix_of_odd_documents(odd_documents, no_documents):
    same_mix(odd_documents, [(r["doc_id"], r["text"], r["source"]) for r in odd_documents.collect()])
    assert mixing.mix_sources(no_documents).collect() == []
    mixed = mixing.mix_sources(odd_documents).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"), F.first("copies").alias("copies")).collect()
    repeated = mixing.apply_mix(odd_documents)
    assert repeated.columns == odd_documents.columns
    assert repeated.count() == sum(r["rows"] * r["copies"] for r in mixed)


# -- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(keys, fps, bits=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    out = {}
    for i, k in enumerate(keys):
        out.setdefault(find(i), []).append(k)
    least = {r: min((k for k in own if k is not None), default=None) for r, own in out.items()}
    return [least[find(i)] for i in range(len(fps))]


def test_simhash_against_all_pairs(spark, documents, odd_documents):
    rows = [(i, t) for i, t, _, _ in documents]
    rng = np.random.default_rng(6)
    for i, t, _, _ in documents[:40]:  # near copies
        words = t.split(" ")
        words[int(rng.integers(len(words)))] = "other"
        rows.append((1000 + i, " ".join(words)))
    rows += [(None if r["doc_id"] is None else 5000 + r["doc_id"], r["text"]) for r in odd_documents.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash")).repartition(6)
    fps = [plain_fingerprint(t) for _, t in rows]
    wanted = Counter(zip([k for k, _ in rows], (f"{f:016x}" for f in fps), plain_groups([k for k, _ in rows], fps)))
    for shard in (100_000, 30):  # one shard, and a tree of several
        got = Counter(tuple(r) for r in simhash.simhash_groups(df, shard=shard).collect())
        assert got == wanted


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    near = base[:700] ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    ball = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near, near ^ np.uint64(6), ball]))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    wanted = {(int(fps[a]), int(fps[b])) for a, b in zip(i, j) if a < b}
    tree = simhash.build_top(fps, 4, 2, rng)
    row, shard, home = simhash.route(tree, fps, 2)
    assert sorted(row[home].tolist()) == list(range(len(fps))), "every fingerprint has one home"
    got = set()
    for s in range(int(shard.max()) + 1):
        here = shard == s
        for a, b in simhash.close_pairs(fps[row[here & home]], fps[row[here & ~home]], 2, rng):
            got |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert got == wanted and shard.max() > 4


def test_simhash_of_no_documents(no_documents, odd_documents):
    assert simhash.simhash_groups(no_documents).collect() == []
    assert simhash.keep_one_per_group(no_documents).collect() == []
    kept = simhash.keep_one_per_group(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.where("doc_id = 0").count() == 1 and kept.where("doc_id = 24").count() == 0
    assert kept.where("doc_id = 20").count() == 1, "documents without words are one group"


def test_one_of_each_group_stays_under_null_and_repeated_keys(spark):
    words = [f"word{i}" for i in range(300)]
    near = lambda n: " ".join(words[:-1] + [f"end{n}"])
    other, third = " ".join(f"other{i}" for i in range(50)), " ".join(f"third{i}" for i in range(50))
    rows = [(None, near(0)), (None, near(1)), (None, near(1)), (None, other), (5, third), (5, third + " x"), (5, near(2)), (9, third), (2, other), (2, other)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, _row string, _key int").repartition(3)
    groups = {r["fingerprint"] for r in simhash.simhash_groups(df, bits=12).collect()}
    assert len(groups) > 3, "near copies have fingerprints of their own"
    kept = sorted((tuple(r)[:2] for r in simhash.keep_one_per_group(df, bits=12).collect()), key=repr)
    texts = {t: next(i for i, x in enumerate((near(0)[:20], other[:20], third[:20])) if t.startswith(x)) for _, t in kept}
    assert sorted((k, texts[t]) for k, t in kept) == [(2, 1), (5, 0), (5, 2)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 500)] + [(7, 7), (3, 2)] + [(900, 901), (901, 902), (902, 900)]
    found = components.connected_components(spark.createDataFrame(chain, "u bigint, v bigint"))
    wanted = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(500)} | {900: 900, 901: 900, 902: 900}
    assert {r["node"]: r["root"] for r in found.collect()} == wanted


# -- suffix dedup -------------------------------------------------------------------------------


def plain_removal(rows, length):
    seen, out = set(), Counter()
    rank = lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 63))
    for key, text in sorted(rows, key=rank):
        data = (text or "").encode()
        cover = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(data[i : i + length])
        kept = bytes(b for b, c in zip(data, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out[(key, len(data), sum(cover), spans, kept)] += 1
    return out


@pytest.mark.parametrize(("run_bytes", "hot"), [(1 << 23, 1000), (1 << 14, 1000), (1 << 15, 3)])
def test_removal_against_a_set_of_windows(spark, documents, odd_documents, run_bytes, hot):
    rows = [(i, t) for i, t, _, _ in documents[:60]]
    rows += [(i + 100, "x" * i + t[50:400]) for i, t, _, _ in documents[:30]]
    rows += [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    rows += [(300, "a" * 3000), (301, "ab" * 700), (302, "x" * 99), (303, "x" * 100), (304, "x" * 101)]
    line = "The common line that very many documents share stands here, and it has well over one hundred bytes in it."
    rows += [(400 + i, f"é{i} " * (i % 9) + line + f" tail {i * 7}" * 9) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("run", F.lit("clash")).repartition(4)
    left = sd.remove_repeats(df, run_bytes=run_bytes, hot=hot)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in left.collect())
    assert got == plain_removal(rows, sd.LENGTH)


def test_texts_without_repeats(odd_documents, no_documents):
    left = sd.without_repeats(odd_documents)
    assert left.columns == odd_documents.columns and left.count() == odd_documents.count()
    assert left.schema["n_chars"].dataType == odd_documents.schema["n_chars"].dataType
    assert left.where("n_chars <> char_length(text)").count() == 0
    assert {r["_text"] for r in left.collect()} == {"clash"}
    assert sd.remove_repeats(no_documents).collect() == []


def test_loser_tree_and_front_coding():
    rng = np.random.default_rng(12)
    for _ in range(150):
        runs = [sorted(bytes(rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 14))).tolist()) for _ in range(int(rng.integers(0, 9)))) for _ in range(int(rng.integers(1, 10)))]
        coded = [sd.front_coded(r) for r in runs]
        assert [sd.decoded(*c) for c in coded] == runs
        before, out = b"", []
        for run, place, known in sd.merged(runs, [c[0].tolist() for c in coded]):
            suffix = runs[run][place]
            assert suffix[:known] == before[:known] and (not before or suffix[: known + 1] != before[: known + 1] or suffix == before)
            out.append(suffix)
            before = suffix
        assert out == sorted(x for r in runs for x in r)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(13)
    text = bytes(rng.integers(97, 100, 400).tolist())
    for _, _, buf, starts, ends in text_blocks(pa.array([text, b"x" * 37 + text[100:350], text[5:90]])):
        lo, hi, p, h, text_of = sd.anchored(buf, starts, ends)
        found = {}
        for a, b, q, x in zip(lo, hi, p, h):
            for i in range(a, b + 1):
                found.setdefault(buf[i : i + 100].tobytes(), set()).add((q - i, x))
        assert all(len(v) == 1 for v in found.values()) and sum(hi - lo + 1) == 301 + 37 + 250 - 99


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline_against_plain_stages(spark, tokenizer_file):
    """Each stage on what its predecessor kept, checked against the plain version of its operator."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = stages["toxicity"](spark, docs, sf).cache()
    clean = {k for k, v in labels.items() if not v}
    assert clean <= {r["doc_id"] for r in kept.collect()} and kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    least = plain_groups([k for k, _ in rows], [plain_fingerprint(t) for _, t in rows])
    single = stages["simhash near-dedup"](spark, kept, sf).cache()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(least))
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    left = stages["suffix-array dedup"](spark, single, sf).cache()
    wanted = {k: kept.decode("utf-8", "ignore") for k, _, _, _, kept in plain_removal(rows, 100)}
    assert {r["doc_id"]: r["text"] for r in left.collect()} == wanted
    rows = [(r["doc_id"], r["text"], r["source"]) for r in left.collect()]
    mixed = stages["mixing sources to target weights"](spark, left, sf).cache()
    copies = Counter(r["doc_id"] for r in mixed.collect())
    for key, size, _, _, taken in plain_mix(rows):
        assert size == 0 or copies[key] == taken // size
    pieces = stages["packing"](spark, mixed, sf)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n <> 4096").count() <= 1


def test_pipeline_of_no_documents(spark, no_documents, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    no_documents.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
