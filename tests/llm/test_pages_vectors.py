"""Operators on pages and embeddings against brute force."""

import base64
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from vecloom.llm import html_text, pivot_search, warc


def page(i, extra=""):
    return f'<html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><article><h1>Title {i}</h1><p>Fish &amp; chips&nbsp;{i}<br>two <b>th</b>ree<p>more {i}</p>{extra}<div class="comments"><p>bad</p></div></article><footer>&copy; x</footer></body></html>'


WANT = "Title {0} Fish & chips {0} two three more {0}"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>one<p>two", "one two"), ("<div>a<div>b</div>c</div>", "a b c"),
        ("<main><p>in</p></main><p>out</p>", "in"), ("<article>a &am", "a &am"), ("<article>a<p cla", "a"), ("<body><form>x</form><p hidden>y</p><p>z</p>", "z"),
        ('<body><div id="cookie-notice">x</div><div role="navigation">y</div><div class="adSlot">q</div><p class="added">z</p>', "z"), ("<ul><li>a<li>b</ul>", "a b"),
        ('<div class="widget"><article>kept</article></div>', "kept"), ("<article><header><h2>t</h2></header>x</article>", "t x"), ("<p title='a>b'>x</p><!-- <p>no</p> -->y", "x y"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<script>if (a<b) {}</script>x<style>p{}</style>", "x"), ("<p>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_extract(html, text):
    assert html_text.extract(html) == text


@pytest.fixture(scope="module")
def pages(spark):
    share = "<div><ul><li>Tell a friend</li></ul></div>"
    rows = [(i, f"http://a.org/{i}", page(i, share)) for i in range(12)] + [(14 + i, "http://b.org/x", page(i, f"<div>own {i}</div>")) for i in range(3)]
    rows += [(20 + i, f"https://user@C.org:80/{i}", f"<div><p>Welcome to this site</p></div><div><p>story {i}</p></div>") for i in range(4)]
    rows += [(30, None, page(1)), (31, "http://d.org", None), (None, "http://d.org", ""), (5, "http://a.org/5", page(5, share))]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, hashes string")


@pytest.mark.parametrize("limit", [10**6, 0])
def test_templates_go(pages, limit):
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages, limit).collect()}
    assert all(got[i] == WANT.format(i) for i in range(12))
    assert all(got[14 + i] == WANT.format(i) + f" own {i}" for i in range(3))
    assert all(got[20 + i] == f"story {i}" for i in range(4))
    assert got[30] == WANT.format(1) and got[31] == got[None] == ""
    assert html_text.main_text(pages, limit).count() == pages.count() and html_text.main_text(pages.limit(0), limit).count() == 0


def test_templates_against_counting(spark):
    """Shares of a host's pages counted in Python, inside and outside of articles; without the step the text differs."""
    rng = random.Random(12)
    rows = []
    for i in range(90):
        host = f"h{i % 3 if i % 2 else 3 + i % 3}.org"
        outside = [f"<div>{w}</div>" for w in "abcdef" if rng.random() < 0.08 * (1 + "abcdef".index(w))]
        inside = [f"<p>{w} {host}</p>" for w in ("one", "two", "three", "four") if rng.random() < 0.3 * (1 + ("one", "two", "three", "four").index(w))]
        rows.append((i, f"http://{host}/{i}", (f"<p>own {i}</p>" + "".join(outside)) if i % 2 else f"<article><p>own {i}</p>{''.join(inside)}</article>"))
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    changed = 0
    for i, url, html in rows:
        host = [r for r in rows if r[1].split("/")[2] == url.split("/")[2]]
        want = []
        for block in re.findall(r"<(?:p|div)>.*?</(?:p|div)>", html):
            n, inside = sum(block in h for _, _, h in host), "<article>" in html
            if n < (max(10, math.ceil(0.8 * len(host))) if inside else max(3, math.ceil(0.1 * len(host)))):
                want.append(re.sub("<.*?>", "", block))
        assert got[i] == " ".join(want), i
        changed += got[i] != html_text.extract(html)
    assert changed > 20


def test_only_template_is_empty(spark):
    rows = [(i, f"http://a.org/{i}", f"<div>menu</div><p>{i}</p>") for i in range(5)] + [(9, "http://a.org/9", "<div>menu</div>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: str(i) for i in range(5)} | {9: ""}


def test_prose_of_articles_is_not_judged_by_class():
    html = '<article><h1>Copyright law</h1><p id="copyright">a</p><p class="related">b</p><div class="search results">c</div><label>d</label><div class="comments"><p>no</p></div><div class="ad">no</div></article>'
    assert html_text.extract(html) == "Copyright law a b c d"


@pytest.mark.parametrize(
    "html", ["<p" + " " * 300_000 + ">x", '<div class="ad">' * 30_000 + "<article>x", "<b>" * 30_000 + "</i>" * 30_000 + "x", "<p>" + "<h1>" * 30_000 + "x", '<a b="' * 30_000 + "x", "<" * 300_000 + "x", "<li>" * 30_000 + "x", "<!--" * 50_000 + "x", "<script>" * 30_000 + "x"],
)
def test_long_pages_take_linear_time(html):
    began = time.perf_counter()
    html_text.extract(html)
    assert time.perf_counter() - began < 3


def test_repeated_articles_are_no_template(spark):
    rows = [(i, "http://a.org/", "<div><p>the very same article</p></div>") for i in range(20)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == "the very same article" for r in got)


@pytest.fixture(scope="module")
def captured(spark):
    rng = random.Random(5)
    same = "<p>é same</p>"
    rows = [(i, f"http://h{i % 7}.example.org/p/{i}?q={i}#f", f"<p>page {i}\r\n\r\n{'x' * rng.randrange(400)}</p>") for i in range(40)]
    rows += [(50, "http://a.org", same), (51, "https://www.b.org:443/é x\n", same), (52, None, same), (53, "http://a.org", None), (54, "ftp://a.org", ""), (55, "http://a.org", "<p>u</p>"), (55, "http://a.org", "<p>u</p>"), (None, "http://z.org", "<p>n</p>"), (None, "http://z.org", same)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")


def test_archive_round_trip(spark, captured):
    rows, df = captured
    a = warc.Archive.write(df, file_bytes=2000)
    got = sorted(map(tuple, warc.captures(a, df).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        held = max(ids, default=None)
        again = i is not None and held is not None and i < held
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", held if again else None))
    assert got == sorted(want, key=str)
    files = spark.read.format("binaryFile").load(a.records).where("path LIKE '%part-%'").collect()
    n = 0
    for f in files:
        at = 0
        while at < len(f["content"]):
            fields, _, at = warc.read_record(f["content"], at)
            n += 1
            assert fields["WARC-Type"] in ("response", "revisit")
    assert n == len(rows) and len(files) > 1


def test_one_page_id_on_two_pages(spark):
    """A revisit has the bytes and the digest of the payload it shares, not of another page under that page_id."""
    rows = [(1, "http://a.org/1", "long payload " * 9), (9, "http://a.org/9", "long payload " * 9), (9, "http://b.org/9", "other"), (2, "http://b.org/2", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.captures(warc.Archive.write(pages), pages).collect()))
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(i, len(h), digest(h), "response" if i == 9 else "revisit", None if i == 9 else 9) for i, _, h in rows]
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)


def test_large_payload_bound(captured):
    rows, df = captured
    out = warc.captures(warc.Archive.write(df, least_bytes=10**6), df)
    assert out.count() == len(rows) and out.where("record_type <> 'response'").isEmpty()


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lookup(spark, captured, monkeypatch, limit):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows, df = captured
    a = warc.Archive.write(df, file_bytes=2000)
    assert a.directory().count() > 10
    urls = ["http://h3.example.org/p/3?q=3", "http://a.org/", "http://nowhere.org/"]
    found = a.lookup(spark.createDataFrame([(u,) for u in urls], "url string"), limit)
    assert sorted(r["page_id"] for r in found.collect()) == [3, 50, 53, 54, 55, 55]  # keys leave the scheme out
    page = {r["page_id"]: bytes(r["payload"]) for r in a.read(found.where("type = 'response'")).collect()}
    assert page[3] == rows[3][2].encode()
    a.records = "other" + a.records  # a store that only Spark reads takes the other way
    assert warc.url_key("http://WWW.B.org:80/x") == "org,b,www)/x" and warc.url_key(None) == ""


def test_empty_archive(captured):
    none = captured[1].limit(0)
    assert warc.captures(warc.Archive.write(none), none).count() == 0


def test_captures_search_the_directory(spark, captured, monkeypatch):
    """Only the captures of the URLs asked for are read, also under one key that fills many blocks."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = [(i, "http://a.org/ x" if i % 3 else f"http://b{i % 5}.org/", f"page {i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = warc.Archive.write(pages, file_bytes=100)
    got = warc.captures(a, pages.where("page_id = 1")).collect()
    assert sorted(r["page_id"] for r in got) == [i for i in range(60) if i % 3]
    assert all(r["payload_bytes"] == len(f"page {r['page_id']}") for r in got)


def brute(rows, step, k, d=8):
    fine = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == d]
    out = {}
    for q, qv in fine:
        if q is not None and q % step == 0:
            s = sorted((-float((x * qv).sum()), i) for i, x in fine if i != q)
            out[q] = [(i, -d) for d, i in s[:k]]
    return out


def test_pivot_search_small_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * (1 + i % 3)]) for i in range(90)]
    rows += [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [1.0, None] * 4), (104, [1.0]), (105, rows[4][1]), (106, rows[4][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in pivot_search.nearest(df, 20, 5, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows, 20, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(a[1] == pytest.approx(b[1]) for q in want for a, b in zip(got[q], want[q], strict=True))
    assert pivot_search.nearest(df.limit(0), 20).count() == 0
    few = pivot_search.nearest(df.where("vec_id < 4"), 20, 20)
    assert few.count() == 3


def test_inverted_files_hold_every_place():
    rng = np.random.default_rng(2)
    perm = np.stack([rng.permutation(12)[:5] for _ in range(40)]).astype(np.int16)
    begins, posted = pivot_search.inverted(perm, 12)
    for pivot in range(12):
        for place in range(5):
            c = pivot * 5 + place
            assert sorted(posted[begins[c] : begins[c + 1]]) == np.flatnonzero(perm[:, place] == pivot).tolist()


def test_pivot_search_ranks_by_footrule():
    """The candidates of a block against footrule distances written out."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = x[:20]
    perm = pivot_search.permutations(x, pivots, 10)
    begins, posted = pivot_search.inverted(perm, 20)
    part = {"n": 300, "ids": np.arange(300).tobytes(), "vecs": x.tobytes(), "begins": begins.tobytes(), "posted": posted.tobytes()}
    k, share = 3, 0.1
    ids, scores = pivot_search.block_search(x[:5], np.arange(5), perm[:5], part, k, share)
    wanted = 30 + pivot_search.EXTRA * k + 1
    for q in range(5):
        far = np.array([sum(min(abs(list(p).index(v) - i), pivot_search.WINDOW + 1) if v in p else pivot_search.WINDOW + 1 for i, v in enumerate(perm[q])) for p in perm])
        edge = np.sort(far)[wanted - 1]
        sure, maybe = set(np.flatnonzero(far < edge)) - {q}, set(np.flatnonzero(far <= edge)) - {q}
        got = ids[q].tolist()
        assert set(got) <= maybe and scores[q].tolist() == sorted(scores[q], reverse=True)
        assert all((x[i] * x[q]).sum() <= scores[q][-1] + 1e-12 for i in sure - set(got))


@pytest.mark.parametrize("size", ["sf0.1", "sf0.01"])
def test_pivot_search_recall_at_shipped_parameters(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding")
    got = {}
    for r in pivot_search.nearest(df, 20).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    want = brute(rows, 20, 20, 64)
    assert len(want) > 20
    hits = sum(len(got[q].keys() & {i for i, _ in v}) for q, v in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(got[q][i] == pytest.approx(s, abs=1e-12) for q, v in want.items() for i, s in v if i in got[q])


def test_pivot_search_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = [sorted(map(tuple, pivot_search.nearest(df.repartition(n), 100, 10, block=400).collect())) for n in (1, 16, 211)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 120


def test_templates_go_by_share_at_any_size(spark):
    page = lambda i: f"<body><div>site line</div><p>page {i} says this</p>{'<ul><li>common</li><li>list</li></ul>' if i < 60 else ''}</body>"
    rows = [(i, f"http://big.example/{i}", page(i)) for i in range(1000)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"page {i} says this" + (" common list" if i < 60 else "") for i in range(1000)}  # 60 of 1,000 is no template
