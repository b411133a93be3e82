"""URL lists, HTML extraction and WARC against brute force and round trips."""

import gzip
import hashlib
import io
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cognatus.llm import archive, boilerplate, queries, urllists, warc
from cognatus.llm.htmltext import read_page

PAGES = "page_id long, url string, html string"
SMALL = "/root/testdata/sf0.001"


# -- URL lists


def brute(captures, entries):
    out = []
    for url, at in captures:
        m = re.match(r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "")
        host, path = (m[1].lower().rstrip("."), m[2]) if m else ("", "")
        best = None
        for lst, kind, pattern, action, since in entries:
            same = [e for e in entries if e[:3] == (lst, kind, pattern) and e[4] is not None]
            if None in (kind, pattern, action, since, at, url) or action == "remove" or since > at:
                continue
            if any(since < e[4] <= at for e in same) or (action == "allow" and any(e[4] == since and e[3] == "block" for e in same)):
                continue
            hit = {
                "url": url == pattern,
                "host": host != "" and host == pattern,
                "domain": host != "" and (host == pattern or host.endswith("." + pattern)),
                "prefix": host != "" and path.startswith("/") and (host + path == pattern or (host + path).startswith(pattern + "/")),
            }.get(kind, False)
            if hit:
                rank = (("domain", "host", "prefix", "url").index(kind), len(pattern), action == "block", since, lst or "", pattern)
                best = max(best or rank, rank)
        out.append((url, at, "pass" if best is None else "block" if best[2] else "allow", None if best is None else best[5], None if best is None else best[3]))
    return out


def test_lists(spark):
    rng = random.Random(2)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "ab.org"]
    kinds = {"host": hosts, "domain": [*hosts, "com"], "prefix": ["a.com/p", "a.com/p/q", "b.org/p"], "url": ["http://a.com/p/q?x=1"]}
    entries = []
    for _ in range(80):
        kind = rng.choice(list(kinds))
        entries.append((rng.choice(["l1", "l2"]), kind, rng.choice(kinds[kind]), rng.choice(["block", "allow", "remove"]), rng.randrange(0, 200) * 86400))
    entries += [("l", None, "a.com", "block", 0), ("l", "host", None, "block", 0), ("l", "host", "a.com", None, 0), ("l", "host", "a.com", "block", None), ("l", "odd", "a.com", "block", 0)]
    captures = [(f"{s}{h}{p}", rng.randrange(0, 230) * 86400 + rng.randrange(3)) for h in hosts for p in ("", "/", "/p", "/p/q?x=1", "/pp#f", "/p/q/r") for s in ("http://", "https://u:p@")]
    captures += [("HTTP://A.COM:80/p", 86400), (None, 5), ("", 5), ("no url", 5), ("http://a.com/p", None), captures[0], captures[0]]
    seconds = lambda c: F.timestamp_seconds(c)
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, at long").withColumn("listed_at", seconds("at"))
    c = spark.createDataFrame(captures, "url string, at long").withColumn("fetched_at", seconds("at")).withColumn("verdict", F.lit("clash"))
    got = [(r["url"], r["at"], r["verdict"], r["pattern"], r["s"]) for r in urllists.judge(c, e).withColumn("s", F.unix_timestamp("since")).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute(captures, entries), key=key)
    assert len({r[2] for r in got}) == 3
    assert urllists.judge(c.limit(0), e).count() == 0
    assert {r["verdict"] for r in urllists.judge(c, e.limit(0)).collect()} == {"pass"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for view in ("pages", "embeddings", "documents"):
        duck.sql(f"CREATE VIEW {view} AS SELECT * FROM '{SMALL}/{view}.parquet'")
    got = queries.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want, key=key)


def test_native_plan(spark):
    plan = queries.op4_urllists(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Cartesian" not in plan


# -- HTML


PAGE = """<!doctype html><html><head><title>T</title><script>if(a<b){"</p>"}</script><style>p{}</style></head>
<body class="page has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use</div>
<div class="wrapper with-sidebar"><nav><ul><li>a</ul></nav><article class="post"><header class="entry-header"><h1>Title &amp; more</h1></header>
<p>One  two<br>three <b>bold<p class=x>Four &copy; five<div class="ad">Buy<div>inner</div></div>tail<ul><li>L1<li>L2</ul><aside>side</aside>
<form>f</form><section id="comments"><article class="comment"><p>c1</article></section>
<p>End &lt;p&gt; x<span class="advert">ad <span>y</span></span> z<!-- note --></article><aside class=sidebar>S</aside></div><footer>F</footer></body></html>"""


def test_regions():
    page = read_page(PAGE)
    assert page.main == ["Title & more", "One two three bold", "Four © five", "tail", "L1", "L2", "End <p> x z"]
    for broken in (None, "", "<", "<p", "a <b c='d", "x<!-- y", "</p></div>", "<script>x", "<p>5 < 6 and 7 > 3</p>"):
        read_page(broken)
    assert read_page("<p>5 < 6 and 7 > 3</p>").open_blocks == ["5 < 6 and 7 > 3"]


@pytest.mark.parametrize(
    "opening",
    ['div class="ad-container"', 'div class="cookie-wrapper"', 'div class="sidebar no-print"', 'div class="page-sidebar"', 'div class="wrapper comments"', 'div id="page-footer"',
     'div class="nav-container"', 'ul class="social-links"', 'div class="share"', 'div class="related-posts-2"', 'div class="search-box"', 'span class="sponsored"', 'section class="post-comments"'],
)
def test_names_that_tell(opening):
    page = read_page(f"<article><p>before</p><{opening}>gone</{opening.split()[0]}><p>after</p></article>")
    assert page.main == ["before", "after"]


@pytest.mark.parametrize(
    "opening",
    ['section class="social-science"', 'section class="results-search"', 'section class="share"', 'section class="response"', 'section id="search"', 'div class="market-share"',
     'div class="immune-response"', 'div class="wrapper with-sidebar"', 'div class="no-ads"', 'div class="ad-free"', 'div class="sidebar-layout"', 'div class="content-sidebar-wrap"',
     'div class="page-with-comments"', 'div class="entry-header"', 'div class="page-header"', 'div class="container"', 'div class="adaptation"', 'math'],
)
def test_names_that_do_not_tell(opening):
    page = read_page(f"<article><p>before</p><{opening}><p>kept</p></{opening.split()[0]}><p>after</p></article>")
    assert page.main == ["before", "kept", "after"]


def test_formulas_stay():
    source = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> hold.</p></article>"
    assert read_page(source).main == ["Let x=2 hold."]


def test_linear_time():
    import time

    for evil in ("<a '" * 50_000, "<" * 200_000, "<!--" * 50_000, "<div class='" * 30_000, "<p>" * 100_000, "<div>" * 20_000, "<div>" * 30_000 + "</x>" * 30_000):
        start = time.process_time()
        read_page(evil)
        assert time.process_time() - start < 20


def texts(spark, rows, **kind):
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))
    return sorted(((r["id"], r["url"], r["text"]) for r in boilerplate.main_texts(df, **kind).collect()), key=str)


def test_article_keeps_what_pages_share(spark):
    shared = "passage " + " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"http://h.com/{i}", f"<nav>menu {i}</nav><article><p>own {i}</p><p>{shared}</p></article><footer>f</footer>") for i in range(6)]
    assert texts(spark, rows) == sorted(((i, u, f"own {i}\n{shared}") for i, u, _ in rows), key=str)


def test_host_boilerplate_goes(spark):
    menu = " ".join(f"item{i}" for i in range(15))
    rows = [(i, f"http://h.com/{i}", f"<div><p>Home page links</p><p>{menu} unique{i} end{i}</p><p>Body of page {i} as written</p></div>") for i in range(6)]
    rows += [(7, "http://other.org/", f"<p>{menu}</p>"), (8, None, None), (9, "x", ""), (10, "http://one.net", "plain text"), rows[0], rows[0]]
    got = texts(spark, rows)
    want = [(i, f"http://h.com/{i}", f"unique{i} end{i}\nBody of page {i} as written") for i in range(6)]
    want += [want[0], want[0], (7, "http://other.org/", menu), (8, None, ""), (9, "x", ""), (10, "http://one.net", "plain text")]
    assert got == sorted(want, key=str)
    assert texts(spark, rows, shard=1) == got  # which task sorts a suffix changes nothing
    assert texts(spark, []) == []


def test_copies_keep_their_text(spark):
    page = "<p>" + " ".join(f"w{i}" for i in range(30)) + "</p><p>short</p>"
    rows = [(i, f"http://h.com/{i}", page) for i in range(4)]
    want = " ".join(f"w{i}" for i in range(30)) + "\nshort"
    assert texts(spark, rows) == sorted(((i, u, want) for i, u, _ in rows), key=str)


def test_furniture_goes_from_articles_too(spark):
    line = " ".join(f"f{i}" for i in range(12))
    rows = [(i, f"http://h.com/{i}", f"<article><p>own text {i}</p><p>{line if i == 0 else 'more'}</p></article><footer>{line}</footer>") for i in range(8)]
    want = [(i, u, f"own text {i}" + ("" if i == 0 else "\nmore")) for i, u, _ in rows]
    assert texts(spark, rows) == sorted(want, key=str)
    assert texts(spark, rows[:4])[0][2] == f"own text 0\n{line}"  # four pages tell too little


def test_runs_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        blocks = [" ".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 6, 12, 30]))) for _ in range(3)]
        rows.append((i, f"http://{'h' if i % 3 else 'g'}.com/{i}", "".join(f"<p>{b}</p>" for b in blocks)))
    least, pages = 5, {}
    for i, url, source in rows:
        pages[i] = (url[7], source[3:-4].split("</p><p>"))
    want = []
    for i, url, _ in rows:
        host, blocks = pages[i]
        others = [b for j, (h, bs) in pages.items() if h == host and bs != blocks for b in bs]
        runs = {tuple(w[k : k + least]) for w in map(str.split, others) for k in range(len(w) - least + 1)}
        out = []
        for b in blocks:
            w = b.split(" ")
            keep = [True] * len(w)
            if len(w) < least:
                keep = [b not in others] * len(w)
            for k in range(len(w) - least + 1):
                if tuple(w[k : k + least]) in runs:
                    keep[k : k + least] = [False] * least
            marked = " ".join(x if on else "|" for x, on in zip(w, keep))
            out += [x.strip() for x in marked.split("|") if x.strip()]
        want.append((i, url, "\n".join(out)))
    assert texts(spark, rows, least=least) == texts(spark, rows, least=least, shard=7) == sorted(want, key=str)


def test_suffix_runs():
    import numpy as np

    rng = random.Random(6)
    for _ in range(60):
        pages = [[rng.randrange(3) for _ in range(rng.randrange(0, 25))] for _ in range(4)]
        stream = np.array([t for p in pages for t in [*p, -1]], np.int64)
        owner = np.array([k for k, p in enumerate(pages) for _ in [*p, -1]], np.int64)
        want, at = [], 0
        for k, p in enumerate(pages):
            own = [False] * (len(p) + 1)
            for i in range(len(p) - 3):
                if any(p[i : i + 4] == q[j : j + 4] for m, q in enumerate(pages) if m != k for j in range(len(q) - 3)):
                    own[i : i + 4] = [True] * 4
            want += own
            at += len(own)
        assert boilerplate.repeated(stream, owner, 4).tolist() == want


# -- WARC


def test_archive_round_trip(spark, tmp_path):
    big, small = "x" * 150 + "é", "tiny"
    rows = [(5, "http://a/5", big), (3, "http://a/3", big), (9, "http://a/9 \r\n", big), (1, "u", small), (2, "u", small), (4, None, None), (6, "u", ""), (None, "u", big), (7, "u", "y" * 3_000_000), (3, "http://a/3", big)]
    archive.archive(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w")
    got = {(r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archive.captures_in(spark, f"file://{tmp_path}/w").collect()}
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        again = h == big and i != 3
        want.add((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == want
    archive.archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e")
    assert archive.captures_in(spark, f"file://{tmp_path}/e").count() == 0


def test_files_are_standard_gzip(spark, tmp_path):
    archive.archive(spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * 50) for i in range(20)], PAGES).coalesce(2), f"file://{tmp_path}/w")
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == 20


def test_filters_are_pushed(spark, tmp_path):
    warc.register(spark)
    archive.archive(spark.createDataFrame([(i, f"http://a/{i}", "z" * 200) for i in range(4)], PAGES), f"file://{tmp_path}/w")
    df = spark.read.format("warc").load(f"file://{tmp_path}/w").where("record_type = 'revisit' AND target_uri LIKE 'http://a/%'").select("record_id")
    assert df.count() == 3
    plan = df._jdf.queryExecution().toString()
    assert "Filter (" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("zipped", [False, True])
def test_foreign_files(zipped):
    """Plain files, and members without the length field, are read in order."""
    records = [warc.record_bytes({"WARC-Type": t, "WARC-Record-ID": f"<urn:{t}>"}, b"body " + t.encode() * 3000) for t in ("warcinfo", "response", "metadata")]
    data = b"".join(gzip.compress(r) if zipped else r for r in records)
    seen = list(warc.read_records(pa.PythonFile(io.BytesIO(data), "r"), len(data), zipped, lambda h: h["warc-type"] != "response", True))
    assert [(h["warc-type"], p) for h, p in seen] == [(t, b"body " + t.encode() * 3000) for t in ("warcinfo", "metadata")]


def test_failed_attempts_are_not_read(spark, tmp_path):
    archive.archive(spark.createDataFrame([(1, "u", "a")], PAGES), f"file://{tmp_path}/w")
    (tmp_path / "w" / "part-stray.warc.gz").write_bytes(b"half a file")
    assert archive.captures_in(spark, f"file://{tmp_path}/w").count() == 1


def record(kind, block, pad=b""):
    return pad + b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(block), block)


def read_all(data, zipped, keep=lambda h: True, payload=True):
    return [(h["warc-type"], b) for h, b in warc.read_records(pa.PythonFile(io.BytesIO(data), "r"), len(data), zipped, keep, payload)]


def test_odd_archives_are_read_whole():
    some = [(b"response", b"one"), (b"metadata", b"x\r\n\r\nWARC/1.0 " * 9000), (b"response", b""), (b"revisit", b"last\r\n")]
    want = [(k.decode(), b) for k, b in some]
    joined = b"".join(record(k, b) for k, b in some)
    assert read_all(joined, False) == want
    assert read_all(b"\r\n" + joined + b"\r\n\r\n", False) == want
    assert read_all(gzip.compress(joined), True) == want  # several records in a member
    assert read_all(gzip.compress(joined[:-4]) + gzip.compress(joined), True) == want * 2
    assert read_all(gzip.compress(joined), True, lambda h: h["warc-type"] == "response", False) == [("response", None)] * 2
    assert read_all(joined, False, lambda h: h["warc-type"] == "revisit") == want[3:]
    assert read_all(b"", False) == read_all(b"", True) == []


def test_cut_archives_raise():
    whole = record(b"response", b"the block " * 50)
    for cut in (10, 40, len(whole) - 100):
        for data, zipped in ((whole + whole[:cut], False), (gzip.compress(whole + whole[:cut]), True), ((gzip.compress(whole) + gzip.compress(whole)[: 40 + cut // 20]), True)):
            with pytest.raises((EOFError, ValueError)):
                read_all(data, zipped)
            with pytest.raises((EOFError, ValueError)):
                read_all(data, zipped, lambda h: False, False)
    with pytest.raises(ValueError, match="length"):
        read_all(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx", False)
    with pytest.raises(ValueError, match="header"):
        read_all(b"something else\r\n\r\n", False)
