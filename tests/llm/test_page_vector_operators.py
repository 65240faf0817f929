"""Operators 6, 8 and 10, components, the pipeline and the SQL of the registered queries."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from conftest import SF_SMALL
from gridweave.llm import common, components, embed_dedup, html_extract, langid, quality_rules, queries, simhash, sos_packing, warc
from gridweave.plans.tables import TABLES
from tools.oracle_check import compare

PAGES = "page_id long, url string, html string, key string, size long, blocks string, host string, text string"


def _page(page_id, html, url="http://a.example/x"):
    return (page_id, url, html, "k", 1, "b", "h", "t")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    r = compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF_SMALL, con)
    assert r["ok"], r


def test_all_are_registered():
    assert [f"op{n}" for n in range(1, 14)] == sorted((n.split("_")[0] for n in queries.queries()), key=lambda x: int(x[2:]))


# --- operator 6 -------------------------------------------------------------------------------


def _text(html):
    return " ".join(t for t, _ in html_extract.blocks(html)[0])


@pytest.mark.parametrize(("html", "want"), [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b", "a b"),
    ("<p>a <b>b</b>c\n\td<br>e</p>", "a bc d e"),
    ("<body><nav>n</nav><header>h</header><article><h1>T</h1><p>x&nbsp;&#233;</p></article><footer>f</footer>", "T x é"),
    ("<article><header><h1>T</h1></header><p>1</p><aside>s</aside><div class='ad-box'>ad</div><form>f</form><p>2</p></article>",
     "T 1 2"),
    ("<main><p>m</p><section id=comments><article class=comment>c</article></section></main>", "m"),
    ("<div id=content><h1>T</h1><p>x</p></div><div class='sidebar'>s</div><div class='cookie-notice'>c</div>", "T x"),
    ("<div id=content class='has-sidebar no-ads'><p>x</p></div><div class=widget-area>w</div>", "x"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
    ("<div hidden>h</div><div style='display: none'>h</div><p>v</p>", "v"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
    ("<p>1 < 2 <", "1 < 2 <"),
    ("<p>cut <a href=", "cut"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
])
def test_blocks_of_one_page(html, want):
    assert _text(html) == want


STORY = "a long story " * 30


@pytest.mark.parametrize(("html", "want"), [
    (f"<h1 class='entry-title'>T</h1><div class='text'><p>{STORY}</p></div>", f"T {STORY}"),
    (f"<div class='post-meta'>By X</div><div class='text'>{STORY}</div>", f"By X {STORY}"),
    (f"<div class='content'><p>short</p></div><div class='text'><p>{STORY}</p></div>", f"short {STORY}"),
    (f"<div>Top</div><div class='entry-content'><p>{STORY}</p></div>", STORY),
    (f"<div>Top</div><div id='post-12'><p>{STORY}</p></div>", STORY),
    (f"<div>Top</div><main><h1>T</h1><p>{STORY}</p><article><h3>Teaser</h3><p>card</p></article></main>",
     f"T {STORY} Teaser card"),
    (f"<article><h3>Teaser</h3><p>card</p></article><main><h1>T</h1><p>{STORY}</p></main>", f"T {STORY}"),
    (f"<body><header>Site</header><p>{STORY}</p><article><header>Teaser</header><p>card</p></article>", f"{STORY} Teaser card"),
])
def test_a_container_holds_most_of_the_text(html, want):
    assert _text(html) == " ".join(want.split())


@pytest.mark.parametrize(("html", "want"), [
    (f"<form id=aspnet><nav>n</nav><article><h1>T</h1><p>{STORY}</p></article><div class=sidebar>s</div></form>", f"T {STORY}"),
    (f"<div class='layout sidebar-left'><nav>n</nav><main><p>{STORY}</p></main></div>", STORY),
    (f"<div id=page class='widget-ready'><p>{STORY}</p><div class=widget>w</div></div>", STORY),
    (f"<form><div class='layout sidebar-left'><p>{STORY}</p><form>f</form></div></form><div>Top</div>", f"{STORY} Top"),
    ("<div class='layout sidebar-left'><article><p>short</p></article></div>", "short"),
    (f"<div class='comments-open'><article><p>{STORY}</p></article></div>", STORY),
    (f"<nav><ul><li>n</li></ul><article><p>{STORY}</p></article>", STORY),
    (f"<head><title>t</title><body class='comments-open'><p>{STORY}</p>", STORY),
    (f"<article><p>{STORY}</p></article><div class=related><article>card</article><article>card</article></div>", STORY),
    (f"<article><p>{STORY}</p></article><aside><article>card</article></aside><form><p>Name</p></form>", STORY),
    (f"<article><p>short</p></article><div id=comments><p>{STORY}</p><article class=comment>{STORY}</article></div>", "short"),
    (f"<p>short</p><div class=ad-slot><article class=ad>{STORY[:6]}</article></div>", "short"),
])
def test_a_wrapper_of_the_page_is_not_dropped(html, want):
    assert _text(html) == " ".join(want.split())


def test_templates_go_articles_stay(spark):
    rows = []
    for i in range(40):
        promo = "<div><span>Read our app</span><div>now</div></div>"
        rows.append(_page(i, f"<body><div>Site box</div><article><p>story {i}</p>{promo}<p>The same sentence.</p></article>"))
        rows.append(_page(100 + i, f"<body><div>Top of page</div><p>story {i}</p>", "http://b.example:80/"))
        rows.append(_page(200 + i, "<body><div>copy</div><p>copied page</p>", "http://c.example/"))
    rows += [_page(900, None), _page(901, "", None), _page(None, "<p>x</p>", "nonsense"), _page(0, rows[0][2])]
    r = html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(r) == len(rows)
    got = {x["page_id"]: x["text"] for x in r}
    assert all(got[i] == f"story {i} The same sentence." for i in range(40))
    assert all(got[100 + i] == f"story {i}" for i in range(40))
    assert all(got[200 + i] == "copy copied page" for i in range(40))
    assert got[900] == got[901] == "" and got[None] == "x"
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_templates_of_a_part_of_a_large_host_go(spark):
    rows = []
    for i in range(60):
        promo = f"<div><p>All about section {i % 6}</p><ul><li>now</li></ul></div>"
        rows.append(_page(i, f"<body><article><p>story {i}</p>{promo}<p>Said before {i % 6}.</p></article>"))
        rows.append(_page(100 + i, f"<body><p>story {i}</p>{promo}<p>Said before {i % 6}.</p>", "http://b.example/"))
        again = f"<div>{'told again ' * 60}</div>" if i < 8 else ""
        rows.append(_page(200 + i, f"<body><article><p>day {i}</p>{again}<table><tr><td>yes<td>{i}</table></article>",
                          "http://c.example/"))
        few = "<div>rare</div>" if i < 4 else ""
        rows.append(_page(300 + i, f"<article><p>story {i}</p>{few}</article>", "http://d.example/"))
    got = {x["page_id"]: x["text"] for x in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows)
    for i in range(60):
        assert got[i] == got[100 + i] == f"story {i} Said before {i % 6}."
        assert got[200 + i].startswith(f"day {i}") and ("told again" in got[200 + i]) == (i < 8)
        assert got[300 + i] == f"story {i}" + (" rare" if i < 4 else "")


def test_page_query_gives_the_articles(spark):
    import html as H
    import re

    pages = {p["page_id"]: p["html"] for p in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    for r in html_extract.query(spark, SF_SMALL).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(H.unescape(re.sub(r"<[^>]*>", " ", inner)).split()) and r["n_chars"] == len(r["text"])


# --- operator 8 -------------------------------------------------------------------------------


def _b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize("least", [0, 10])
def test_archive_round_trip(spark, tmpdir_path, least):
    rows = [_page(1, "<p>same payload</p>"), _page(5, "<p>same payload</p>"), _page(3, "<p>same payload</p>"),
            _page(5, "<p>same payload</p>"), _page(6, None), _page(7, ""), _page(8, "é" * 3), _page(9, "é" * 3),
            _page(None, "<p>same payload</p>"), _page(None, "x" * 50_000), _page(11, "big" * 400_000, None),
            _page(12, "y", "http://e/\r\nWARC-Type: bad")]
    warc.write_archive(spark.createDataFrame(rows, PAGES), f"{tmpdir_path}/a", min_revisit_bytes=least)
    got = warc.read_archive(spark, f"{tmpdir_path}/a").collect()
    assert len(got) == len(rows)
    payloads = spark.read.parquet(f"{tmpdir_path}/a/payloads")
    assert payloads.count() == len({(r[2] or "") for r in rows})
    body = {}
    for r in rows:
        body.setdefault(r[0], []).append((r[2] or "").encode())
    for r in got:
        assert bytes(r["payload"]) in body[r["page_id"]] and r["payload_bytes"] == len(r["payload"])
        assert r["payload_digest"] == _b32(bytes(r["payload"]))
        head, http, block = bytes(r["record"]).split(b"\r\n\r\n", 2)
        lines = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and lines[b"WARC-Type"].decode() == r["record_type"]
        block = block[:-4]
        assert int(lines[b"Content-Length"]) == len(http) + 4 + len(block)
        assert block == (b"" if r["record_type"] == "revisit" else bytes(r["payload"]))
    kind = {}
    for r in got:
        kind.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
    assert sorted(kind[5], key=str) == [("response", None), ("revisit", 5)] and kind[1] == kind[3] == [("revisit", 5)]
    assert ("revisit", 5) in kind[None] and ("response", None) in kind[None]
    small = [("revisit", 9)] if least == 0 else [("response", None)]
    assert kind[8] == small and kind[9] == [("response", None)]
    assert kind[6] == ([("revisit", 7)] if least == 0 else [("response", None)])


def test_damaged_payload_stops_the_read(spark, tmpdir_path):
    pages = spark.createDataFrame([_page(1, "abc")], PAGES)
    warc.write_archive(pages, f"{tmpdir_path}/a")
    spark.createDataFrame([(hashlib.sha256(b"abc").hexdigest(), bytearray(b"abd"))], "key string, payload binary"
                          ).write.mode("overwrite").parquet(f"{tmpdir_path}/a/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{tmpdir_path}/a").collect()


def test_empty_archive(spark, tmpdir_path):
    warc.write_archive(spark.createDataFrame([], PAGES), f"{tmpdir_path}/a")
    assert warc.read_archive(spark, f"{tmpdir_path}/a").count() == 0


# --- operator 10 ------------------------------------------------------------------------------


def _brute(vectors, threshold=0.95):
    """(links, component) per position; vectors that cannot link have neither."""
    ok = [i for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = [0] * len(vectors), list(range(len(vectors)))

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    unit = {i: np.array(vectors[i], float) / np.linalg.norm(np.array(vectors[i], float)) for i in ok}
    for a in ok:
        for b in ok:
            if a < b and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return links, [find(i) for i in range(len(vectors))]


def test_hadamard_keeps_norms():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = embed_dedup.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(embed_dedup.hadamard(y), x)


@pytest.mark.parametrize("cell", [1000, 40])
def test_groups_of_near_copies(spark, cell):
    rng = np.random.default_rng(3)
    rows = []
    for size, noise in ((150, 0.02), (30, 0.03), (2, 0.03), (1, 0), (70, 0.0)):
        base = rng.normal(size=64)
        base /= np.linalg.norm(base)
        rows += [(base + noise * rng.normal(size=64)).astype(np.float32).tolist() for _ in range(size)]
    rows += [rng.normal(size=64).astype(np.float32).tolist() for _ in range(200)]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embed_dedup.linked_vectors(df, cell=cell).collect()}
    links, comp = _brute(rows)
    assert sum(got[i]["n_links"] for i in got) >= 0.99 * sum(links)
    assert all(got[i]["n_links"] <= links[i] for i in got)
    same = sum(got[i]["component_id"] == comp[i] for i in got)
    assert same >= 0.99 * len(rows)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(600):  # pairs at cosine 0.951
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [a.tolist(), (0.951 * a + np.sqrt(1 - 0.951**2) * b).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = [r["n_links"] for r in embed_dedup.linked_vectors(df).collect()]
    assert sum(got) >= 0.9 * 1200


@pytest.mark.parametrize(("width", "n"), [(64, 4000), (768, 800)])
def test_pairs_at_the_threshold_meet(width, n):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, width))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = embed_dedup.codes(a), embed_dedup.codes(0.9501 * a + np.sqrt(1 - 0.9501**2) * b)
    assert ((x == y[:, :, :1]).any(2) | (y == x[:, :, :1]).any(2)).any(1).mean() >= 0.998


def test_vectors_that_link_with_nothing(spark):
    good = [1.0, 0.5] + [0.0] * 6
    rows = [(1, good), (2, good), (2, good), (3, None), (4, []), (5, [0.0] * 8), (6, [float("nan")] + good[1:]),
            (7, [None] + good[1:]), (8, [float("inf")] + good[1:]), (None, good), (9, good[:4]), (10, [3.0, 1.5] + [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, node long")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.linked_vectors(df).collect()]
    assert len(got) == 12
    assert sorted(got, key=str) == sorted(
        [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (10, 4, 1, False), (9, 0, 9, True),
         *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)]], key=str)
    assert embed_dedup.linked_vectors(df.limit(0)).count() == 0


# --- components and pipeline --------------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    pairs += [(2000, 2000 + i) for i in range(100)] + [(5, 5), (None, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    up = {}

    def find(n):
        up.setdefault(n, n)
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in list(up)}
    assert components.connected_components(df.limit(0)).count() == 0


def test_pipeline_is_its_operators_in_order(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = langid.train(docs)
    known = {r["doc_id"] for r in langid.predict(docs, model).where("lang_pred <> 'und' and score >= 0.3").collect()}
    one = docs.where(docs.doc_id.isin(list(known)))
    good = {r["doc_id"] for r in quality_rules.judge(one).where("kept").collect()}
    two = docs.where(docs.doc_id.isin(list(good)))
    first = {r["doc_id"] for r in simhash.near_duplicates(two).where("doc_id = component_id").collect()}
    got = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    want = sos_packing.pack(docs.where(docs.doc_id.isin(list(first)))).toPandas()
    assert set(got.doc_id) == first and len(good) < docs.count()
    assert got.groupby("doc_id").length.sum().to_dict() == want.groupby("doc_id").length.sum().to_dict()


def test_pipeline_stages_on_messy_rows(spark):
    text = " ".join(f"word{i} goes" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en", "s", 1, "x"), (1, text, "en", "s", 1, "x"), (2, None, None, None, None, None),
                                  (None, text, "en", "s", 1, "x"), (3, "", "en", "s", 0, "y")],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, None), "t")
        assert out.columns == docs.columns
        assert corpus_pipeline.STAGES and stage(spark, docs.limit(0), None).count() == 0
    assert common.release_scratch(spark) > 0
