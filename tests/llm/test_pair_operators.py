"""Near duplicates, repeated strings, decontamination, archives, licenses."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from llm_rows import edge, no_rows  # noqa: F401  (fixtures)

from quarry.llm import (common, components, decontam, html_extract, jaccard, license_scan,
                        suffix_dedup, warc)
from quarry.llm import suite as llm_suite

SF001 = "/root/testdata/sf0.001"


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long")


# ---------------------------------------------------------- near duplicates

def plain_links(rows):
    cache = common.WordHashes()
    sets = [(i, jaccard.shingle_set(t, cache)) for i, t in rows]
    links, parent = Counter(), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            both = len(set(s.tolist()) & set(u.tolist()))
            if both and both * 5 >= 4 * (len(s) + len(u) - both):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i, _ in rows}


def near_copies():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7)))
    passage = [word() for _ in range(40)]
    rows, n = [], 0
    for group in (1, 2, 3, 7, 40, 700):  # the last one is larger than a block
        base = [word() for _ in range(80)]
        for _ in range(group):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                own[r.randrange(80)] = word()
            rows.append((n, " ".join(own)))
            n += 1
    for _ in range(150):  # a passage that unlike documents share
        rows.append((n, " ".join([word() for _ in range(60)] + passage)))
        n += 1
    return rows


def test_join_against_all_pairs(spark):
    rows = near_copies()
    want = plain_links(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(documents(spark, rows))
           .collect()}
    assert got == want


def test_join_of_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = plain_links([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()}
    assert got == want


def test_deep_splits_lose_no_pair(spark, monkeypatch):
    """Small nodes force many levels; the pairs stay the same."""
    monkeypatch.setattr(jaccard, "BUCKET", 4)
    monkeypatch.setattr(jaccard, "BLOCKS", 0)
    rows = near_copies()[:53] + near_copies()[-150:]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(documents(spark, rows))
           .collect()}
    assert got == plain_links(rows)


def test_join_edges(spark, edge, no_rows):
    got = jaccard.join(edge).collect()
    assert len(got) == edge.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.class_id, r.copy_id, r.n_links))
    assert by[1] == [(1, 1, 0)] and by[2] == [(2, 2, 0)]
    assert by[5] == [(5, 5, 2)] * 2 and by[6] == [(5, 5, 2)]
    assert by[7] == by[8] == [(7, 7, 1)]
    assert by[None] == [(None, None, 0)] * 3
    assert jaccard.join(no_rows).collect() == []
    kept = jaccard.pipeline_stage(spark, edge, SF001)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 0, 1, 2, 3, 4, 5, 7, 9]


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(3, 3)], [(i, i + 1) for i in range(60)], [(5, i) for i in range(40)],
    [(random.Random(i).randrange(80), random.Random(-i).randrange(80)) for i in range(60)]])
def test_components(spark, edges):
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    want = {n: root(n) for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.component for r in got.collect()} == want


# --------------------------------------------------------- repeated strings

def plain_dedup(rows):
    """Rows in order of id; rows of one id don't see each other."""
    seen, out = set(), {}
    for i in sorted({i for i, _ in rows}, key=lambda i: (i is None, i)):
        own = set()
        for j, t in rows:
            if j != i:
                continue
            b = (t or "").encode()
            hit = bytearray(len(b))
            for k in range(len(b) - 49):
                w = b[k:k + 50]
                own.add(w)
                if w in seen:
                    hit[k:k + 50] = b"\1" * 50
            kept = bytes(x for x, h in zip(b, hit) if not h)
            runs = sum(1 for k, h in enumerate(hit) if h and not (k and hit[k - 1]))
            out.setdefault(i, set()).add((len(b), sum(hit), runs,
                                          hashlib.sha256(kept).hexdigest()))
        if i is not None:
            seen |= own
    return out


def digests(docs):
    out = {}
    for r in suffix_dedup.dedup(docs).selectExpr(
            "doc.doc_id", "size n", "removed", "spans",
            "sha2(coalesce(kept, cast('' as binary)), 256) sha").collect():
        out.setdefault(r.doc_id, set()).add((r.n, r.removed, r.spans, r.sha))
    return out


def test_dedup_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    parts = ["".join(r.choice("ab é\n") for _ in range(r.randint(20, 140))) for _ in range(12)]
    for i in range(120):
        t = "".join(r.choice(parts) if r.random() < .4 else
                    "".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 90)))
                    for _ in range(r.randint(0, 6)))
        rows.append((i // 2 * 2 if i % 10 == 1 else i, t))
    rows += [(500, "a" * 300), (501, "a" * 120), (502, "b" * 49), (503, "b" * 49),
             (None, parts[0] * 3), (None, parts[0] * 3), (504, None), (505, "")]
    docs = documents(spark, rows).repartition(5)
    assert digests(docs) == plain_dedup(rows)


def test_dedup_of_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert digests(docs) == plain_dedup([(r.doc_id, r.text) for r in docs.collect()])


def test_dedup_edges(spark, edge, no_rows):
    got = {}
    for r in suffix_dedup.dedup(edge).select("doc.doc_id", "removed", "spans").collect():
        got.setdefault(r.doc_id, []).append((r.removed, r.spans))
    assert got[7] == [(0, 0)] and got[8][0][1] == 1 and got[1] == [(0, 0)]
    assert suffix_dedup.dedup(no_rows).collect() == []
    kept = suffix_dedup.pipeline_stage(spark, edge, SF001)
    assert kept.columns == edge.columns
    assert 8 not in {r.doc_id for r in kept.collect()}


# ---------------------------------------------------------- decontamination

def plain_hits(text, items):
    words = [w.decode() for w in common.words_of(text)]
    hit, found = set(), set()
    for item, t in items:
        own = [w.decode() for w in common.words_of(t)]
        m = min(10, len(own))
        for k in range(len(own) - m + 1 if m and item is not None else 0):
            for i in range(len(words) - m + 1):
                if words[i:i + m] == own[k:k + m]:
                    hit |= set(range(i, i + m))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 5, 9, 10, 11, 14, 25]))) for i in range(25)]
    items += [(3, "W1, w2!"), (None, text(12)), (30, None), (31, items[4][1]), (31, items[4][1])]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1] + [(40, "Zé")]
    rows = []
    for i in range(60):
        parts = [text(r.randint(0, 20)) if r.random() < .6 else r.choice(items)[1] or ""
                 for _ in range(3)]
        rows.append((i, " ".join(parts)))
    rows += [(60, None), (61, ""), (62, "zé"), (63, "xZé")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids)
           for r in decontam.find(documents(spark, rows), bench).collect()}
    assert got == {i: plain_hits(t, items) for i, t in rows}


def test_decontamination_edges(spark, edge, no_rows):
    bench = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    got = decontam.find(edge, bench).collect()
    assert len(got) == edge.count()
    assert sorted(r.doc_id for r in got if r.n_hit) == [5, 5, 6]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(edge, none).where("n_hit > 0").count() == 0
    assert decontam.find(no_rows, bench).collect() == []
    kept = decontam.pipeline_stage(spark, edge, SF001)
    assert kept.columns == edge.columns and kept.count() == edge.count()


# ----------------------------------------------------------------- archives

PAGES = [(1, "http://www.b.org:80/x#f", "<p>one</p>"), (2, "https://a.b.org/", "<p>one</p>"),
         (3, None, None), (4, "bad\r\nurl x", ""), (None, "http://a.b.org/", "<p>one</p>"),
         (5, "http://b.org/x", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n\r\n\r\nWARC/1.1\r\n é"),
         (5, "http://b.org/x", "twice"), (6, "//b.org?q", "\r\n\r\n" * 5), (7, "x", "z" * 300_000)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string") \
        .selectExpr("*", "'x' AS id")
    path = f"{tmp_path}/w"
    warc.write(pages.repartition(3), path)
    got = [r.asDict() for r in warc.merge(warc.read(spark, path)).collect()]
    keys = [(r["url_key"], r["captured"], r["id"]) for r in got]
    assert keys == sorted(keys) and len(got) == len(PAGES)
    by = {(r["id"], r["payload_bytes"]): r for r in got}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        r = by[warc.NO_ID if i is None else i, len(raw)]
        first = min((warc.NO_ID if j is None else j) for j, _, h in PAGES
                    if (h or "") == (html or ""))
        assert r["payload_digest"] == warc.digest(raw)
        assert r["refers_to"] == (None if r["id"] == first else first)
        assert r["record_type"] == ("response" if r["id"] == first else "revisit")
    assert by[1, 10]["url_key"] == "org,b)/x" and by[4, 0]["url"] == "bad%0D%0Aurl%20x"


def test_small_payloads_are_not_revisited(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w", min_revisit=11)
    assert warc.read(spark, f"{tmp_path}/w").where("record_type = 'revisit'").count() == 0


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/w")
    assert warc.merge(warc.read(spark, f"{tmp_path}/w")).collect() == []


def test_loser_tree():
    r = random.Random(2)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for v in runs for x in v)


# -------------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";
</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul></nav>
<header>Site header words</header><div class="cookie-notice">We use cookies on this site today</div>
<%s><h1>Caf&eacute;</h1><p>First   paragraph &amp; <b>bold</b>\n words of the text.<br><p>Second
one, <a href="x">with a link</a> inside.</p><div class="ad">Buy this now please</div>
<form><label>Mail</label><input></form><blockquote>Quoted words stand here.</blockquote></%s>
<div id="comments"><p>I like this page a lot, really.</p></div><aside>See also these</aside>
<footer>&copy; words words words</footer></body></html>"""
MAIN = ("Café\nFirst paragraph & bold words of the text.\nSecond one, with a link inside.\n"
        "Quoted words stand here.")


def test_extraction(spark):
    rows = [(i, f"u{i}", PAGE % ("article", "article")) for i in range(5)]
    rows += [(5, "u5", PAGE % ("div", "div")), (6, None, None), (7, "u", ""), (None, "u", "<p>a"),
             (8, "u8", PAGE % ("article", "article") * 1), (9, "u", "plain words only"),
             (10, "u", "<a <b \" x> text <"), (11, "u", (PAGE % ("article", "article"))[:420])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights = html_extract.fit(pages)
    got = {r.page_id: r for r in html_extract.extract(pages, weights).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == MAIN and got[i].n_chars == len(MAIN) for i in (0, 4, 5, 8))
    assert got[6].text == got[7].text == "" and got[9].text == "plain words only"
    none = pages.limit(0)
    assert html_extract.fit(none) == {} and html_extract.extract(none, {}).collect() == []
    assert html_extract.main_text("<p>a b</p>", {}) == "a b"


def test_extraction_of_pages(spark):
    """All that the supplied pages have between article tags, and nothing else."""
    import html
    import re
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.op6_html_extraction(spark, SF001).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        body = re.sub(r"<(?!/?p>|/?h1>)[^>]*>", lambda m: " " if m[0] == "<br>" else "", body)
        parts = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert got[r.page_id] == "\n".join(x for x in parts if x)


def test_best_region_is_that_of_all_regions():
    r = random.Random(6)
    for _ in range(200):
        weights = {f"w:{k}": r.choice([-2.0, -1.0, .5, 1.0]) for k in "abc"}
        found = [html_extract.Node(f"w:{r.choice('abc')}", "x " * r.randint(1, 3), False, False,
                                   False) for _ in range(r.randint(0, 12))]
        score = [weights[n.kind] * len(n.text.split()) for n in found]
        best = max([0.0] + [sum(score[i:j]) for i in range(len(score))
                            for j in range(i + 1, len(score) + 1)])
        a, b = html_extract.region(found, weights)
        assert sum(score[a:b]) == pytest.approx(best)


def test_wrappers_of_content_are_no_asides(spark):
    page = PAGE % ("article", "article")
    wrapped = [
        page.replace("<body>", '<body class="no-sidebar search">'),
        page.replace("<html>", '<html class="has-banner menu">'),
        page.replace("<article>", '<article class="post comments-open search">'),
        page.replace("article>", "main>").replace("<main>", '<main class="search results">'),
        *(page.replace("<article>", f"<{w}><article>").replace("</article>", f"</article></{w[:4]}>")
          for w in ('div class="content has-sidebar"', 'div class="site header-fixed"',
                    'div class="search"', 'form id="all"'))]
    wrapped[-1] = wrapped[-1].replace("<form><label>Mail</label><input></form>", "")
    # articles of comments stay asides beside the article that has fewer around it
    said = '<div id="comments"><article><p>I like this page a lot, really.</p></article></div>'
    wrapped.append(re.sub(r'<div id="comments">.*?</div>', said, page))
    plain = [(i, "u", page) for i in range(5)]
    rows = [(9 + i, "u", w) for i, w in enumerate(wrapped)]
    schema = "page_id long, url string, html string"
    weights = html_extract.fit(spark.createDataFrame(plain, schema))
    got = html_extract.extract(spark.createDataFrame(rows, schema), weights).collect()
    assert {r.page_id: r.text for r in got} == {i: MAIN for i, _, _ in rows}
    assert html_extract.fit(spark.createDataFrame(rows[:1] * 5, schema)) == weights
    div = PAGE % ('div class="content has-sidebar"', "div")
    assert html_extract.main_text(div, weights) == MAIN


def test_asides_within_content(spark):
    """Compounds, hidden elements and learned names are left out, the article's own header is not."""
    schema = "page_id long, url string, html string"
    page = PAGE % ("article", "article")
    first = "<blockquote>Quoted"
    blocks = ['<div class="%s"><p>Words that are not of the article.</p></div>' % c for c in
              ("related-posts", "comment-list", "comments-section", "share-buttons", "sidebar-left",
               "cookie-bar", "ad-container", "adsbygoogle", "hidden", "relatedPosts", "zz-unit")]
    blocks += ["<div hidden>Not to be seen by anyone.</div>",
               '<p style="color:red; display: none">Not to be seen by anyone.</p>',
               '<article class="comment"><p>I like this page a lot, really.</p></article>']
    kept = ['<div data-id="ad" title="hidden comments"><p>%s</p></div>', '<p class="no-ads">%s</p>',
            '<header class="entry-header"><h2>%s</h2></header>', '<header><p>%s</p></header>']
    plain = [(i, "u", page.replace("<footer>", '<div class="zz-unit">Other words</div><footer>'))
             for i in range(2 * html_extract.OUTSIDE)]
    weights = html_extract.fit(spark.createDataFrame(plain, schema))
    assert "zz-unit" in html_extract.learned_names(weights)
    for b in blocks:
        assert html_extract.main_text(page.replace(first, b + first), weights) == MAIN, b
    for k in kept:
        text = html_extract.main_text(page.replace(first, k % "Words that are kept." + first),
                                      weights)
        assert text == MAIN.replace("Quoted", "Words that are kept.\nQuoted"), k
    # with no article on the page, what holds most of its words is no aside by a compound's begin
    assert html_extract.main_text('<div class="menu-layout"><p>a b c d</p></div>', {}) == "a b c d"
    assert html_extract.main_text('<div class="menu-layout"><p>a</p></div><p>b c d</p>',
                                  {}) == "b c d"


def test_pages_of_unmatched_tags_take_linear_time():
    import time
    from collections import Counter
    n = 60_000
    for page in ("<b>" * n + "</i>" * n, "<b>" * n + "<div></div>" * n, "<p><b>" * n + "<p>" * n,
                 "<div class='x'>" * n + "<article>" * n, "</b>" * n, "<" * n, "<b x='" * n):
        start = time.process_time()
        html_extract.nodes(page, seen=Counter())
        assert time.process_time() - start < 4, page[:20]


# ----------------------------------------------------------------- licenses

def test_scan(spark):
    mit = "Released under the MIT License."
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "r/LICENSE", mit), (2, "r/a/b.py", "code words"), (3, "r/x/COPYING", f"Hi\n{gpl}"),
            (4, "r/x/y/z.py", "more code"), (5, "r/x/y/own.py", f"head\nAll rights reserved.\nx"),
            (6, "top.py", "none"), (7, None, mit), (8, "r/n", None), (9, "r/e", ""),
            (None, "r/x/k", "k"), (2, "r/a/b.py", "code words"), (10, "r/rx/q", "q"),
            (11, "s/only.txt", mit)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")
                            .repartition(4)).collect()
    assert len(got) == len(rows)
    by = {r.file_id: (r.license, r.origin, r.license_path) for r in got}
    assert by[1] == ("MIT", "file", "r/LICENSE")
    assert by[2] == ("MIT", "inherited", "r/LICENSE")
    assert by[3] == ("GPL-3.0", "file", "r/x/COPYING")
    assert by[4] == by[None] == ("GPL-3.0", "inherited", "r/x/COPYING")
    assert by[5] == ("Proprietary", "header", "r/x/y/own.py")
    assert by[6] == (None, None, None) and by[7] == ("MIT", "file", None)
    assert by[8] == by[9] == by[10] == ("MIT", "inherited", "r/LICENSE")
    assert by[11] == ("MIT", "file", "s/only.txt")


def test_scan_edges(edge, no_rows):
    from pyspark.sql import functions as F
    got = license_scan.scan(edge.withColumn("path", F.lit("a/b"))).collect()
    assert len(got) == edge.count() and all(r.license is None for r in got)
    assert license_scan.scan(no_rows.withColumn("path", F.lit("a/b"))).collect() == []


def test_scan_is_native(spark):
    plan = license_scan.op10_license_scan(spark, SF001)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_scan_terms_without_regular_expressions(spark):
    from pyspark.sql import functions as F
    texts = ["", " ", "a", "The  MIT-License,v2\n\t(c) 2020", "".join(map(chr, range(128))) * 2,
             "\x00a\x00\x00B", "É\u00a0ÀB İK x\u2028y \U0001f600A\u0301", None, "[^]]\\^`{|}~\x7f0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", license_scan.terms(F.col("t")).alias("w")).collect():
        low = r.t and r.t.translate({c: c + 32 for c in range(65, 91)})
        assert r.w == (None if r.t is None else re.findall(license_scan._TERM, low))
    plan = license_scan.op10_license_scan(spark, SF001)._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan  # each took over 200 CPU seconds a GB


# ----------------------------------------------------------- against SQL

@pytest.mark.parametrize("name", sorted(llm_suite.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    want = con.execute(llm_suite.SQL[name])
    names = sorted(d[0] for d in want.description)
    place = {d[0]: i for i, d in enumerate(want.description)}
    rows = [tuple(r[place[n]] for n in names) for r in want.fetchall()]
    df = llm_suite.QUERIES[name](spark, SF001)
    assert sorted(df.columns) == names
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
