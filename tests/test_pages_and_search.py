import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attesta.operators import catalog as I
from attesta.operators import chunking as J
from attesta.operators import extract as E
from attesta.operators import freshness as H
from attesta.operators import grid
from attesta.operators import retrieval as R


def pages(spark, *bodies):
    return spark.createDataFrame(
        [(i, f"https://h.org/p/{i}", b) for i, b in enumerate(bodies)],
        "page_id long, url string, html string")


def test_anchors_skip_comments_and_scripts(spark, rows):
    html = """<!-- <a href="/no">no</a> --><script>var a='<a href="/js">x</a>'</script>
      <a class="k" href='/u/one?x=1&amp;y=2' title=" First&nbsp;unit ">A <b>bold</b>  one</a>
      <a name="anchor">no link</a><A HREF="/u/one">again</A>"""
    got = E.extract_anchors(pages(spark, html))
    assert rows(got, "pos", "href", "title", "text", "slug") == [
        (0, "/u/one?x=1&y=2", "First unit", "A bold one", "one"),
        (1, None, "", "no link", ""), (2, "/u/one", "", "again", "one")]
    assert rows(E.first_title(got), "slug", "name", "pos") == [("one", "First unit", 0)]


def test_accordion_items_find_their_header_by_id(spark, rows):
    html = """<div class="card-header" id="heading-1"><h5><a>UNDERGRADUATE</a></h5></div>
      <div><div class="card-header" id="heading-1-77"><h5><a>BS &amp; BA</a></h5></div></div>
      <div class="card-header" id="heading-9-5"><h5><a>Orphan</a></h5></div>
      <div class="card-header" id="heading-1-78"><h5><a> </a></h5></div>"""
    got = E.extract_nested(pages(spark, html))
    assert rows(got, "item_id", "name", "group_name", "warning") == [
        ("5", "Orphan", None, "item has no group header"),
        ("77", "BS & BA", "UNDERGRADUATE", None), ("78", "", "UNDERGRADUATE", "item has no name")]


def test_cards(spark, rows):
    html = """<article class="card wide"><h3 class="t"><a href="/a/1">One</a></h3>
      <p class="d">text <i>here</i></p><span class="y">4.5 years</span></article>
      <article class="other"><a href="/no">no</a></article>
      <article class="card"><h3 class="t"></h3></article>"""
    spec = E.CardSpec(card=("article", "card"), title=("h3", "t"), text=("p", "d"), badge=("span", "y"))
    assert rows(E.extract_cards(pages(spark, html), spec), "pos", "title", "link", "text", "badge") == [
        (0, "One", "/a/1", "text here", "4.5 years"), (1, "", None, None, None)]


def test_user_parsers_are_routed_and_their_failures_are_rows(spark, rows):
    def good(url, html):
        return {"program": [{"slug": "a"}, {"slug": "b"}]}, ["odd"]

    def bad(url, html):
        raise ValueError("boom")

    registry = E.ParserRegistry(E.SiteParser("good", "a", good, {"program": (1, 9)}),
                                E.SiteParser("bad", "b", bad))
    with pytest.raises(ValueError):
        registry.register(E.SiteParser("good", "a", good))
    df = spark.createDataFrame([(1, "https://h/x", ""), (2, "https://h/y", ""), (3, "https://h/z", "")],
                               "page_id long, url string, html string")
    got = E.extract_records(df, [("^/x", "good"), ("^/y", "bad")], registry)
    assert rows(got, "page_id", "entity_type", "pos", "record", "warning") == [
        (1, "program", 0, '{"slug": "a"}', None), (1, "program", 1, '{"slug": "b"}', None),
        (1, None, None, None, "odd"), (2, None, None, None, "parse failed: boom"),
        (3, None, None, None, "no parser for https://h/z")]
    assert rows(registry.expectations(spark)) == [("a", "program", 1, 9)]
    with pytest.raises(ValueError):
        E.extract_records(df, [("^/x", "missing")], registry)


def test_record_rules(spark, rows):
    df = spark.createDataFrame([("a", "b"), ("a", ""), ("", "b"), ("a", "a")], "x string, y string")
    got = E.prefer(df, "x", "y", "out")
    assert rows(got, "out", "warning") == [
        ("a", "x and y differ; using x"), ("a", None), ("a", None), ("b", None)]
    people = spark.createDataFrame([("Ann", "Department Head"), ("Bob", "Clerk"), ("", "Head")],
                                   "name string, caption string")
    assert rows(E.gate_by_caption(people, "name", "caption"), "published_name", "warning") == [
        ("Ann", None), (None, "caption does not state the role; not published"), (None, None)]
    cls = spark.createDataFrame([("courses-col eaad x",), ("courses-col",)], "c string")
    got = E.owner_from_tokens(cls, ["basd", "eaad"], F.split("c", r"\s+"))
    assert rows(got, "unit_slug") == [("eaad",), (None,)]


def test_embeds_verbatim_and_second_pass(spark, rows):
    df = pages(spark, '<embed src="https://drive.google.com/x"><embed src="/y"><p>Civil &amp;  Eng</p>'
                      '<a href="/p/1/">known</a><a href="/new">new</a><a href="#top">top</a>', "<p>x</p>")
    assert rows(E.flag_embeds(df), "page_id", "embeds", "is_embed") == [(0, 1, True), (1, 0, False)]
    records = spark.createDataFrame([(0, "Civil & Eng"), (0, "Civil Engineering")],
                                    "page_id long, name string")
    assert rows(E.verbatim_check(records, df), "name", "verbatim") == [
        ("Civil & Eng", True), ("Civil Engineering", False)]
    assert rows(E.discover_items(df, df)) == [("https://h.org/new",)]


def test_discovery_fills_the_pattern(spark, rows):
    sites = spark.createDataFrame([("a", "https://a.org")], "site string, origin string")
    slugs = spark.createDataFrame([("a", "x"), ("b", "y")], "site string, slug string")
    assert rows(E.discover(sites, slugs, "{origin}/c/{slug}"), "url") == [("https://a.org/c/x",)]


# --- chunking ----------------------------------------------------------------------------

def words(n, word="w"):
    return " ".join([word] * n)


def chunks_of(spark, text, **limits):
    df = spark.createDataFrame([(1, text)], "entity_id long, markdown string")
    return [(r.path, r.content, r.token_count) for r in
            J.chunk(df, **limits).orderBy("chunk_no").collect()]




def test_sections_keep_their_heading_path(spark):
    text = f"# Book\nintro {words(120)}\n## One\n{words(150, 'a')}\n### Deep\n{words(150, 'b')}\n## Two\n{words(150, 'c')}"
    got = chunks_of(spark, text)
    assert [p for p, _, _ in got] == [[], ["One"], ["One", "Deep"], ["Two"]]
    assert got[2][1] == words(150, "b")


def test_large_sections_split_on_paragraphs_and_repeat_the_path(spark):
    paras = [words(n, f"p{i}") for i, n in enumerate((300, 400, 200, 900, 100))]
    got = chunks_of(spark, "## S\n" + "\n\n".join(paras), merge=0)
    assert [t for _, _, t in got] == [700, 200, 900, 100]
    assert {tuple(p) for p, _, _ in got} == {("S",)}
    assert got[0][1] == paras[0] + "\n\n" + paras[1]


def test_small_sections_join_the_next_sibling_only(spark):
    text = (f"## A\n{words(10, 'a')}\n## B\n{words(20, 'b')}\n### B1\n{words(30, 'c')}\n"
            f"### B2\n{words(200, 'd')}\n## C\n{words(5, 'e')}")
    got = [(p, t) for p, _, t in chunks_of(spark, text)]
    assert got == [(["A"], 30), (["B", "B1"], 230), (["C"], 5)]


def test_html_becomes_markdown(spark):
    html = ("<head><title>t</title></head><nav><h2>no</h2></nav><h1>Top</h1><p>a &amp; b</p>"
            "<h2 class='x'>Sub</h2><ul><li>one</li></ul><!-- c --><script>s</script>")
    got = spark.createDataFrame([(html,)], "h string").select(J.markdown_of_html(F.col("h"))).first()[0]
    assert got == "# Top\n\na & b\n\n## Sub\n\none"


def test_only_new_chunks_go_on(spark, rows):
    schema = "entity_type string, entity_id long, content_hash string"
    new = spark.createDataFrame([("d", 1, "x"), ("d", 1, "x"), ("d", 1, "y"), ("d", 2, "x")], schema)
    old = spark.createDataFrame([("d", 1, "y")], schema)
    assert rows(J.new_chunks(new, old)) == [("d", 1, "x"), ("d", 2, "x")]


# --- retrieval ---------------------------------------------------------------------------

def test_lexical_arm_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = ["the"] * 8 + ["civil", "law", "fee", "exam", "room", "É-x"]
    docs = {i: " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30))) for i in range(60)}
    queries = {1: "the civil", 2: "Law law fee", 3: "the", 4: "missing the", 5: "é x"}

    def tokens(text):
        return re.findall(r"[^\W_]+", text.lower())

    n, avg = len(docs), sum(len(tokens(d)) for d in docs.values()) / len(docs)
    df = {}
    for d in docs.values():
        for t in set(tokens(d)):
            df[t] = df.get(t, 0) + 1
    want = set()
    for q, text in queries.items():
        scored = []
        for i, d in docs.items():
            words_, terms = tokens(d), set(tokens(text))
            if terms <= set(words_):
                score = sum(math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * words_.count(t) * 2.2
                            / (words_.count(t) + 1.2 * (.25 + .75 * len(words_) / avg)) for t in terms)
                scored.append((-round(score, 6), i))
        want |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:10])}
    got = R.lexical_topk(
        spark.createDataFrame(list(queries.items()), "query_id long, text string"),
        spark.createDataFrame(list(docs.items()), "chunk_id long, content string"), 10)
    assert {(r.query_id, r.chunk_id, r.lex_rank) for r in got.collect()} == want


def test_vector_arm_is_exact_over_blocks_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK_ROWS", 2)
    monkeypatch.setattr(R, "SLICE", 3)
    rng = np.random.default_rng(1)
    vectors, asked = rng.normal(size=(200, 8)), rng.normal(size=(5, 8))
    vectors[7] = 0
    vectors[9] = vectors[8]
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1,
                                  np.linalg.norm(m, axis=1, keepdims=True))
    scores = np.round(unit(asked) @ unit(vectors).T, 6)
    want = {(q, int(i), rank + 1) for q in range(5)
            for rank, i in enumerate(np.lexsort((np.arange(200), -scores[q]))[:12])}
    got = R.vector_topk(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)],
                              "query_id int, vector array<double>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None)],
                              "chunk_id long, vector array<double>").repartition(5), 12)
    assert {(r.query_id, r.chunk_id, r.vec_rank) for r in got.collect()} == want


def test_no_queries_give_no_hits(spark):
    queries = spark.createDataFrame([], "query_id int, vector array<double>")
    vectors = spark.createDataFrame([(1, [1.0])], "chunk_id long, vector array<double>")
    assert R.vector_topk(queries, vectors).count() == 0


def test_fusion_evidence_and_metrics(spark, rows):
    lex = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, lex_rank int")
    vec = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 10, 1)],
                                "query_id int, chunk_id int, vec_rank int")
    fused = R.rrf(lex, vec, 2)
    got = {(r.query_id, r.chunk_id): (r.place, r.rrf_score) for r in fused.collect()}
    assert got == {(1, 11): (1, round(1 / 62 + 1 / 61, 9)), (1, 10): (2, round(1 / 61, 9)),
                   (2, 10): (1, round(1 / 61, 9))}
    gold = spark.createDataFrame([(1, 10), (2, 99), (3, 1)], "query_id int, chunk_id int")
    row = R.retrieval_eval(fused, gold, 5).first()
    assert (row.questions, row.recall, row.mrr) == (3, pytest.approx(1 / 3), pytest.approx(1 / 6))
    results = fused.withColumn("site", F.when(F.col("chunk_id") == 11, "a").otherwise("b"))
    asked = spark.createDataFrame([(1, "a"), (2, "a")], "query_id int, site string")
    assert R.contamination(results, asked).first().contamination == 0.5


# --- catalogue and reports ---------------------------------------------------------------

def test_paging_is_complete_at_every_page_size(spark):
    df = spark.range(53).select(F.format_string("k%03d", "id").alias("slug"), (F.col("id") % 3).alias("v"))
    walks = []
    for limit in (5, 100):
        after, seen = None, []
        while True:
            page = I.keyset_page(df, "slug", after, limit).collect()
            seen += [r.slug for r in page]
            if not page or not page[0].has_more:
                break
            after = page[0].next_key
        walks.append(seen)
    assert walks[0] == walks[1] == [f"k{i:03d}" for i in range(53)]
    assert I.keyset_page(df, "slug", "k047", 5).first().has_more is False
    pages_ = {r.slug: r.page for r in I.paginate_all(df, ["slug"], 5).collect()}
    assert pages_ == {f"k{i:03d}": i // 5 for i in range(53)}


def test_digest_ignores_order_and_assembly_time(spark):
    a = spark.createDataFrame([(1, "x", "t1"), (2, "y", "t1")], "n int, s string, at string")
    b = spark.createDataFrame([(2, "y", "t2"), (1, "x", "t2")], "n int, s string, at string")
    c = spark.createDataFrame([(2, "y", "t2"), (1, "z", "t2")], "n int, s string, at string")
    f = [I.result_digest(d, "at").first().fingerprint for d in (a, b, c)]
    assert f[0] == f[1] != f[2]


def test_empty_freshness(spark):
    df = spark.createDataFrame([], "staleness_days int, confidence string, last_verified_at timestamp")
    assert tuple(H.freshness(df).first()) == (None, 0, None, 0, 0, 0)


def test_pct_high_leaves_capped_types_out(spark):
    df = spark.createDataFrame([("a", "program", 1, "high"), ("a", "program", 3, "low"),
                                ("b", "scholarship", 9, "low")],
                               "site string, entity_type string, staleness_days int, confidence string")
    got = {(r.scope, r.site, r.entity_type): (r.rows, r.median_staleness_days, r.pct_high)
           for r in H.freshness_report(df).collect()}
    assert got[("overall", None, None)] == (3, 3.0, 0.5)
    assert got[("site", "b", None)] == (1, 9.0, 0.0)
    assert got[("entity_type", None, "program")] == (2, 2.0, 0.5)


def test_coverage_reports_zero(spark, rows):
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    tables = {"program": spark.createDataFrame([("a",), ("a",)], "site string"),
              "office": spark.createDataFrame([(None,)], "site string")}
    assert rows(H.coverage(tables, sites), "site", "entity_type", "rows") == [
        ("a", "office", 0), ("a", "program", 2), ("b", "office", 0), ("b", "program", 0)]


def test_decay_is_a_recompute(spark, rows):
    import datetime as dt
    now = F.lit(dt.datetime(2026, 8, 29))
    ents = spark.createDataFrame([
        ("program", "p1", "s", "high", dt.datetime(2026, 1, 1)),
        ("program", "p2", "s", "low", dt.datetime(2026, 8, 28))],
        "entity_type string, entity_ref string, source_id string, confidence string, "
        "last_verified_at timestamp")
    src = spark.createDataFrame([("s", "crawl", "active")],
                                "source_id string, method string, source_status string")
    table, events = H.decay(ents, src, now)
    assert rows(events, "entity_ref", "diff") == [
        ("p1", {"confidence": ("high", "medium")}), ("p2", {"confidence": ("low", "high")})]
    assert H.decay(table, src, now)[1].count() == 0


def test_nested_children_come_in_site_order(spark):
    programs = spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, name string")
    offers = spark.createDataFrame([("a", s, f"{s}/a", "active", "A") for s in ("z", "m")],
                                   "program_slug string, site string, ref string, status string, source_name string")
    got = {r.slug: [o.site for o in r.offerings] for r in
           I.program_with_offerings(programs, offers).collect()}
    assert got == {"a": ["m", "z"], "b": []}


def test_wildcards_in_a_search_text_keep_their_meaning(spark, rows):
    df = spark.createDataFrame([("abc",), ("a_c",), ("xyz",)], "name string")
    assert rows(I.listing(df, q="A_C")) == [("a_c",), ("abc",)]


def test_announcements_put_undated_last(spark):
    import datetime as dt
    df = spark.createDataFrame([("x", None), ("y", dt.datetime(2026, 1, 1)), ("z", dt.datetime(2026, 2, 1))],
                               "ref string, published_at timestamp")
    assert [r.ref for r in I.list_announcements(df).collect()] == ["z", "y", "x"]


def test_fees_and_steps(spark, rows):
    fees = spark.createDataFrame([('[{"label":"a","amount":0.1},{"label":"b","amount":0.2},{"label":"c"}]',)],
                                 "line_items string")
    assert str(I.fee_totals(fees).first().total_estimate) == "0.30"
    steps = spark.createDataFrame([("p", '[{"n":1,"title":"a"},{"n":2,"title":"b","detail":"d"}]')],
                                  "ref string, steps string")
    assert rows(I.procedure_steps(steps), "ref", "n", "title", "detail") == [
        ("p", 1, "a", None), ("p", 2, "b", "d")]


def test_extraction_hands_on_a_bounded_number_of_rows(spark, monkeypatch):
    """A batch with many items leaves a task in pieces, and what a task parsed is gone with it."""
    batch = pd.DataFrame({"page_id": [1, 2], "html": ["<li>a</li>" * 7, "<li>b</li>" * 2]})
    pieces = list(E._in_pieces([batch, batch[1:]], lambda i, h: ((i, x) for x in range(h.count("<li>"))),
                               ["page_id", "pos"], {"pos": "int32"}))
    assert [len(p) for p in pieces] == [9, 2]
    monkeypatch.setattr(E, "PIECE_ROWS", 4)
    pieces = list(E._in_pieces([batch, batch[1:]], lambda i, h: ((i, x) for x in range(h.count("<li>"))),
                               ["page_id", "pos"], {"pos": "int32"}))
    assert [len(p) for p in pieces] == [4, 4, 1, 2] and pieces[0]["pos"].dtype == "int32"
    assert [p for x in pieces for p in x["page_id"]] == [1] * 7 + [2] * 4

    pages = E._parsed("<ul><li>a<li>b</ul>")
    page = next(pages)
    item = page.first("li")
    assert item.parent.tag == "ul" and next(pages, None) is None
    assert item.parent is None and not page.children

    monkeypatch.setattr(E, "PIECE_ROWS", 1)
    html = "".join(f'<div id="heading-a-{i}"><h5>item {i}</h5></div>' for i in range(5))
    frame = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert sorted(r["pos"] for r in E.extract_nested(frame).collect()) == list(range(5))
