"""WARC archives, main text of pages and embedding graphs against plain versions of themselves."""

import gzip
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from augspark.llm import embedding_graph as eg, html_text as ht, warc
from augspark.llm.queries import QUERIES

PAGE_SCHEMA = "page_id bigint, url string, html string, key string, payload string, host string, low int, text string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    long_page = "<body><article>" + "<p>some words</p>" * 20_000 + "</article>"
    rows = [(i, f"http://h/{i}", f"<p>page {i % 3} " + "x" * 1500) for i in range(12)]
    rows += [(20, None, None), (21, "", ""), (22, "no url", "short"), (23, "http://h/long", long_page), (24, "http://h/x\r\ny z", "short")]
    rows += [(25, "http://h/r", "r" * 2000), (25, "http://h/r", "r" * 2000), (None, "http://h/n", "r" * 2000), (None, None, None), (-7, "u", "é" * 600)]
    rows += [(26, "http://h/w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60), (27, "x", "\x00\x01﻿<p>")]
    return spark.createDataFrame([(*r, "clash", "clash", "clash", 1, "clash") for r in rows], PAGE_SCHEMA).repartition(3)


# -- WARC ---------------------------------------------------------------------------------------


def plain_archive(rows):
    """What the contract says of each row, as a count."""
    first = {}
    for key, _, page in rows:
        data = (page or "").encode()
        if len(data) >= 1000:
            first[data] = max((k for k in (first.get(data), key) if k is not None), default=None)
    out = Counter()
    for key, _, page in rows:
        data = (page or "").encode()
        again = len(data) >= 1000 and key != first[data]
        out[(key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first[data] if again else None)] += 1
    return out


def test_archives_round_trip(spark, odd_pages, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(odd_pages, path)
    records = warc.read_archives(spark, path)
    assert records.where("gap_reason is not null").count() == 0
    columns = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = Counter(tuple(r) for r in warc.resolved(records).select(columns).collect())
    rows = [(r["page_id"], r["url"], r["html"]) for r in odd_pages.collect()]
    assert got == plain_archive(rows)
    # payloads come back byte by byte, and the files are gzip files for everybody
    stored = Counter(bytes(r["payload"]) for r in records.where("record_type = 'response'").collect())
    wanted = Counter((p or "").encode() for (k, _, p) in rows if (k, len((p or "").encode()), hashlib.sha1((p or "").encode()).hexdigest(), "response", None) in got)
    assert stored == wanted
    for file in (tmp_path / "archives").glob("*.txt"):
        assert gzip.decompress(file.read_bytes()).count(b"WARC-Record-ID: <urn:") >= 0


def test_archives_of_no_pages(spark, odd_pages, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(odd_pages.where("false"), path)
    assert warc.resolved(warc.read_archives(spark, path)).collect() == []


def test_registered_archive_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    out = QUERIES["op4_warc_salvage"](spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in out.collect()) == plain_archive(rows)


def _records(n):
    for i in range(n):
        data = f"payload {i} ".encode() * 50
        yield warc.record_bytes(i, f"http://x/{i}", data, hashlib.sha1(data).hexdigest(), None, False)


@pytest.mark.parametrize("pack", [warc.member, lambda data: data], ids=["gzip", "plain"])
def test_salvage(pack):
    parts = [pack(r) for r in _records(6)]
    whole = b"".join(parts)
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    assert [(f.offset, f.reason) for f in warc.salvage(whole)] == [(s, None) for s in starts[:-1]]
    rng = np.random.default_rng(5)
    for _ in range(120):
        damaged = bytearray(whole)
        hit = int(rng.integers(len(parts)))
        at = int(rng.integers(starts[hit], starts[hit + 1]))
        kind = int(rng.integers(4))
        if kind == 0:
            damaged[at] ^= int(rng.integers(1, 256))
        elif kind == 1:
            del damaged[at : at + int(rng.integers(1, 40))]
        elif kind == 2:
            damaged[at:at] = bytes(rng.integers(0, 256, 30).tolist())
        else:
            del damaged[at:]
        found = list(warc.salvage(bytes(damaged)))
        good = {f.headers["warc-record-id"] for f in found if f.reason is None}
        touched = {hit, hit + 1} if kind == 1 else set(range(hit, 6)) if kind == 3 else {hit}
        assert {f"<{warc.ID_PREFIX}{i}>" for i in range(6) if i not in touched} <= good
        # records, gaps and the blanks between plain records cover the file in order
        at = 0
        for f in found:
            assert f.offset >= at and bytes(damaged[at : f.offset]).strip(b"\r\n") == b""
            at = f.offset + f.length
        assert bytes(damaged[at:]).strip(b"\r\n") == b""
        # what passes the checks is whole, but for headers that no digest of a plain record covers
        payloads = [f"payload {i} ".encode() * 50 for i in range(6)]
        for f in found:
            if f.reason is None and (f.headers["warc-record-id"] != f"<{warc.ID_PREFIX}{hit}>"):
                assert f.block.endswith(tuple(payloads))


def test_salvage_of_odd_files(spark, tmp_path):
    first, second = _records(2)
    files = {"a": b"", "b": b"junk", "c": b"\x1f\x8b\x08 nothing", "d": b"WARC/1.1\r\n", "e": first + second[:-9], "f": warc.member(first) + b"\0" * 99 + second}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read_archives(spark, str(tmp_path), with_payload=False)
    got = Counter((r["path"][-1], r["gap_reason"] is None) for r in rows.collect())
    assert got == Counter({("b", False): 1, ("c", False): 1, ("d", False): 1, ("e", True): 1, ("e", False): 1, ("f", True): 2, ("f", False): 1})
    gap = rows.where("gap_reason is not null and path like '%/f'").first()
    assert (gap["offset"], gap["length"]) == (len(warc.member(first)), 99)


# -- main text ----------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
{box}<article class=post><header><h1>Title {n} &amp; more</h1></header><p>First  paragraph {n}<br>of <b>bold</b>&nbsp;text.
<p>Second &lt;tag&gt; &#233;&#x41; <i>{n}<div class="ad">Buy</div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>
<form><input><button>Send</button></form><aside>Side</aside><!-- no --><section id="comments"><article class="comment"><p>Nice</p></article></section></article>
<div class="sidebar">Side</div><footer>&copy; Foot</footer></body></html>"""


def test_main_text_of_a_page():
    text = ht.Page(PAGE.format(n=1, box="")).text()
    assert text == "Title 1 & more\nFirst paragraph 1 of bold text.\nSecond <tag> éA 1\none\ntwo\na\nb"


def test_what_names_say():
    inner = "<p>Text of the story.</p>"
    for kept in ('class="layout with-sidebar"', 'class="has-comments post"', 'id="mainContent"', 'class="commentary"', 'class="navy"', 'class="comments-open"'):
        assert ht.Page(f"<body><div {kept}>{inner}</div></body>").text() == "Text of the story.", kept
    for gone in ('class="commentlist"', 'id="topNav"', "class=pagefooter", 'class="ad-slot"', 'role="navigation"', 'class="x cookieBar"', 'id="readerComments"', 'class="menu"'):
        assert ht.Page(f"<body><div {gone}>{inner}</div><p>Rest</p></body>").text() == "Rest", gone
    assert ht.Page(f'<article class="post comments-open sidebar-right">{inner}</article>').text() == "Text of the story."
    assert ht.Page(f'<article><header class="entry-header"><h1>T</h1></header>{inner}<article class="comment"><p>c</p></article></article>').text() == "T\nText of the story."


def test_broken_markup():
    assert ht.Page("").text() == "" and ht.Page("<").text() == "<" and ht.Page("a < b > c").text() == "a < b > c"
    assert ht.Page('<p class="x>never closed').text() in ("", 'never closed', '<p class="x>never closed')
    assert ht.Page("<script>if (a<b) x()").text() == "" and ht.Page("<div>a</span></p></div>b</div>").text() == "a\nb"
    assert ht.Page("<p>a<!-- open").text() == "a" and ht.Page("<P>A</P><DIV HIDDEN>B</DIV>").text() == "A"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert ht.Page(deep).text() == "deep"


def test_style_tree_removes_repeated_branches(spark):
    """Without article or telling classes: what reads the same on all pages of a host goes, what differs stays."""
    def page(host, i):
        body = f"<div><div>Welcome to our site</div><div><p>Story {host} {i} " + f"word{i} " * 30 + f"</p><p>End of {i}</p></div><div><span>Call us now</span></div></div>"
        return (i, f"http://{host}/{i}", f"<html><body>{body}</body></html>")

    rows = [page("big.example", i) for i in range(40)] + [page("small.example", 100 + i) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    trees = ht.style_trees(df).where("host = 'big.example'")
    assert trees.agg(F.max("pages")).first()[0] == 40 and trees.where("importance < 0 or importance > 1.000001").count() == 0
    got = {r["page_id"]: r["text"] for r in ht.extract_text(df).collect()}
    for i in range(40):
        assert "Story" in got[i] and f"word{i}" in got[i]
    assert all("Welcome" in got[100 + i] for i in range(2)), "two pages say nothing about their host"


def test_texts_of_articles_that_most_contents_share_go(spark):
    """A notice inside the article goes by the tree; what copies of a page share stays."""
    def page(i, host, story):
        body = f"<h1>Title {story}</h1><p>Please share this story</p><p>Story {story} " + f"word{story} " * 20 + "</p><p>Sign up for our letter</p>"
        return (i, f"http://{host}/{i}", f"<html><body><article>{body}</article></body></html>")

    rows = [page(i, "own.example", i) for i in range(20)] + [page(100 + i, "own.example", "copied") for i in range(30)]
    rows += [page(200 + i, "copies.example", "same") for i in range(30)] + [page(300 + i, "few.example", i) for i in range(4)]
    # near copies: each with a longest block and title of its own, all else the same
    near = "<h1>{0} Title</h1>" + "".join(f"<p>Shared paragraph {k} of the story with some words</p>" for k in range(8)) + "<p>Last " + "changed{0} " * 8 + "</p>"
    rows += [(400 + i, f"http://near.example/{i}", f"<html><body><article>{near.format(i)}</article></body></html>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in ht.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    for i, story in [*((i, i) for i in range(20)), *((100 + i, "copied") for i in range(30))]:
        assert got[i] == f"Title {story}\nStory {story} " + " ".join([f"word{story}"] * 20), got[i]
    for i in (*range(200, 230), *range(300, 304)):
        assert got[i].count("\n") == 3 and "share" in got[i], "one content, or too few, say nothing about their host"
    assert all(got[400 + i].count("Shared paragraph") == 8 for i in range(30))


def test_names_do_not_drop_text_of_a_page(spark):
    """Nothing is left empty by names, and on a host with pages enough the tree speaks for what differs."""
    inner = "<p>Text of the story.</p>"
    for wrapped in ('<div class="elementor-widget-container">{}</div>', '<div class="legal">{}</div>', "<form>{}</form>", '<nav>x</nav><div class="legal"><article>{}</article></div><p>hi</p>'):
        assert ht.Page(f"<body>{wrapped.format(inner)}</body>").text() == "Text of the story.", wrapped
    assert ht.Page("<body><form><p hidden>a</p><script>b</script></form></body>").text() == ""

    def page(i):
        body = f'<div class="widget"><p>Story {i} ' + f"word{i} " * 20 + '</p></div><div class="share"><p>Share it</p></div>'
        body += f'<div class="comments"><p>Comment {i}</p></div><p>About {i}</p><footer><p>Foot</p></footer>'
        return (i, f"http://h.example/{i}", f"<html><body>{body}</body></html>")

    rows = [page(i) for i in range(20)]
    for r in ht.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect():
        i = r["page_id"]
        assert r["text"] == f"Story {i} " + " ".join([f"word{i}"] * 20) + f"\nAbout {i}", r["text"]


def test_importance_against_its_formula(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>{'same' if i < 6 else i}</div>" + "<p>x</p>" * (i % 2)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    hashed = ht._Hash()
    row = ht.style_trees(df).where(F.col("path") == hashed("/body/div")).first()
    assert row["pages"] == 8
    entropy = (6 * np.log(6)) / 8 / np.log(8)
    assert row["content"] == pytest.approx(1 - entropy) and row["presentation"] == pytest.approx(0)
    body = ht.style_trees(df).where(F.col("path") == hashed("/body")).first()
    assert body["presentation"] == pytest.approx(np.log(2) / np.log(8))


def test_odd_pages(odd_pages):
    got = ht.extract_text(odd_pages)
    assert got.columns == ["page_id", "url", "text"] and got.count() == odd_pages.count()
    assert got.where("text is null").count() == 0
    long_text = got.where("page_id = 23").first()["text"]
    assert long_text == "\n".join(["some words"] * 20_000)
    assert ht.extract_text(odd_pages.where("false")).collect() == []


def test_many_low_nodes_are_joined_with_salt(spark, monkeypatch):
    rows = [(i, f"http://h.example/{i}", f"<body><div>same</div><div><p>text {i} of its own</p></div>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    wanted = Counter(tuple(r) for r in ht.extract_text(df).collect())
    monkeypatch.setattr(ht, "BROADCAST_NODES", -1)
    assert Counter(tuple(r) for r in ht.extract_text(df).collect()) == wanted


def test_given_pages_give_their_articles(spark):
    import re
    from html import unescape

    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    for r in QUERIES["op5_html_style_tree"](spark, sf).join(pages, "page_id").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# -- embeddings ---------------------------------------------------------------------------------


def plain_links(rows, threshold=0.95):
    """(key, links, component) per row by comparing all."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = [set() for _ in rows]
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if good[i] and good[j] and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    root = list(range(len(rows)))
    for _ in rows:
        for i, own in enumerate(links):
            for j in own:
                root[i] = root[j] = min(root[i], root[j])
    out = Counter()
    for i, (key, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out[(key, len(links[i]), min(own) if own else None)] += 1
    return out


def vector_rows(n=240, dim=12):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(n, dim))
    base[n // 2 :] = base[: n - n // 2] + rng.normal(size=(n - n // 2, dim)) * 0.12  # near copies
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(n + i, rows[5][1]) for i in range(30)] + [(n + 40, [2 * x for x in rows[6][1]])]
    rows += [(n + 50, None), (n + 51, []), (n + 52, [0.0] * dim), (n + 53, [float("nan")] * dim), (n + 54, [float("inf")] * dim)]
    rows += [(n + 55, [None, *rows[1][1][1:]]), (n + 56, [1.0, 2.0]), (n + 57, [1.0, 2.0]), (n + 57, [1.0, 2.1]), (None, rows[7][1]), (None, None)]
    return rows


@pytest.mark.parametrize(("shard", "block"), [(65_536, 4096), (60, 50)])
def test_embedding_groups_against_all_pairs(spark, shard, block):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<float>, vector string, n int").repartition(5)
    out = eg.near_vector_groups(df, shard=shard, block=block).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == plain_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_embedding_groups_of_no_vectors(spark):
    for rows in ([], [(1, None), (2, [0.0])]):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
        assert sorted(tuple(r) for r in eg.near_vector_groups(df).collect()) == [(k, 0, k, True) for k, _ in rows]


def test_recall_of_the_graph():
    """Links found by the beam on clustered vectors, with clusters larger than the beam."""
    rng = np.random.default_rng(30)
    centres = rng.normal(size=(400, 32))
    vectors = np.repeat(centres, 5, axis=0) + rng.normal(size=(2000, 32)) * 0.1
    crowd = centres[0] + rng.normal(size=(300, 32)) * 0.03
    vectors = np.concatenate([vectors, crowd]).astype(np.float32)
    g = eg.build_graph(vectors)
    got = set()
    for i, j in eg.near_vectors(g, vectors, 0.95, np.random.default_rng(1)):
        got |= set(zip(i.tolist(), j.tolist()))
    x = eg.unit(vectors)
    wanted = set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.951))))
    assert len(wanted & got) / len(wanted) >= 0.99


def test_near_queries_are_searched_together():
    """Queries of 40 clusters in turn: in the order of the search a chunk has few of them, and the links are the same."""
    rng = np.random.default_rng(31)
    centres = rng.normal(size=(40, 32))
    own = np.tile(np.arange(40), 50)
    vectors = (centres[own] + rng.normal(size=(2000, 32)) * 0.02).astype(np.float32)
    g = eg.build_graph(vectors)
    order = g.together(eg.unit(vectors))
    assert sorted(order) == list(range(2000)) and np.mean([len(set(own[order[a : a + 200]])) for a in range(0, 2000, 200)]) < 20
    pairs = lambda q: {(int(q[a]), int(b)) for i, j in eg.near_vectors(g, vectors[q], 0.95, np.random.default_rng(1)) for a, b in zip(i, j)}
    assert pairs(np.arange(2000)) == pairs(rng.permutation(2000)) == {(i, j) for i in range(2000) for j in range(i % 40, 2000, 40)}


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = QUERIES["op7_embedding_small_world"](spark, sf).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == plain_links(rows)
