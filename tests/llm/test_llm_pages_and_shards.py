import html
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from molweave.llm.sharding import op8_shards, stratified_shards, write_shards
from molweave.llm import wrappers
from molweave.llm.wrappers import BELOW, FIXED, ITEMS, KEY, OPTIONAL, REPEATED, add_places, align, boilerplate, generalise, main_text, matched, op7_main_text, parse, places_of
from molweave.session import scratch_path

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a>Home</a><li><a>News</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- x --><main>%s</main>
<aside>More</aside><section class="comments"><p>Reader says</p></section><form><p>Subscribe</p></form>
<script>var a = "</p><p>";</script><footer>&copy; X</footer></body></html>"""


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string")
    return {r["page_id"]: r["text"] for r in main_text(df).collect()}


def test_main_text(spark):
    body = "<article><h1>Head  &amp; line</h1><p>One <b>bold</b>\n word<br>next<p>Two &lt;b&gt;<ul><li>a<li>b</ul></article>"
    want = "Head & line\nOne bold word next\nTwo <b>\na\nb"
    rows = [("https://a.example/1", PAGE % body), ("https://a.example/2", PAGE % "<article><h1>Other</h1><p>Text</p></article>"), ("https://a.example/1", PAGE % body)]
    rows += [(None, PAGE % body), ("not an address", None), ("https://b.example/", ""), ("https://c.example/", "bare words only"), ("https://d.example/", "<div><div class='sidebar'>no</div><p>" + "yes " * 30 + "</div>")]
    got = run(spark, rows)
    assert [got[k] for k in range(8)] == [want, "Other\nText", want, want, "", "", "bare words only", ("yes " * 30).strip()]


def test_hosts_of_mixed_templates(spark):
    article = "<html><body class='%s'><div class='wrap'><article class='post tag-%s'><p>%s</p></article></div></body></html>"
    bodies = [article % ("a", "news", "News of the day"), article % ("a", "sport", "Results of the match"), article % ("b", "news", "A body of another class")]
    bodies += ["<html><body><div class='page'><div class='text'><p>No article here, but some paragraphs</p><p>of plain text</p></div><div>x</div></div></body></html>"]
    bodies += ["<html><body><main><p>Only main</p></main></body></html>"]
    bodies += ["<html><body><article class='one tag-social'><p>First part</p></article><div><article class='two'><p>Second part</p></article></div><article class='comment'>No</article></body></html>"]
    got = run(spark, [(f"https://mixed.example/{i}", b) for i, b in enumerate(bodies)])
    want = ["News of the day", "Results of the match", "A body of another class", "No article here, but some paragraphs\nof plain text", "Only main", "First part\nSecond part"]
    assert [got[k] for k in range(len(want))] == want


def test_constant_texts_of_a_host_are_left_out(spark):
    page = "<body><article><h1>Title {0}</h1><p>Shared line of <b>all</b> pages</p>{1}<p>Join us on <i>every</i> page.</p></article><div>Other {0}</div></body>"
    body = lambda i: "".join(f"<p>In <b>town {i}</b> part {k} of {i}</p>" + "<ul><li>x{}</li></ul>".format(i) * (i % 2) for k in range(1 + i % 3))
    rows = [("https://many.example/", page.format(i, body(i))) for i in range(8)]
    rows += [("https://few.example/", page.format(i, body(i))) for i in range(2)]
    rows += [("https://copies.example/", page.format(1, body(1)))] * 5 + [("https://same.example/", "<body><article><p>A</p></article><p>%s</p></body>" % i) for i in range(4)]
    got = run(spark, rows)
    text = lambda i: [f"Title {i}"] + [x for k in range(1 + i % 3) for x in [f"In town {i} part {k} of {i}"] + [f"x{i}"] * (i % 2)]
    whole = lambda i: "\n".join([f"Title {i}", "Shared line of all pages", *text(i)[1:], "Join us on every page."])
    assert [got[i] for i in range(8)] == ["\n".join(text(i)) for i in range(8)]
    # two pages, or copies of one, are too few to tell; a page of constants only keeps them
    assert [got[8 + i] for i in range(2)] == [whole(0), whole(1)] and {got[10 + i] for i in range(5)} == {whole(1)}
    assert [got[15 + i] for i in range(4)] == ["A"] * 4


def test_wrapper_has_groups_options_and_slots():
    pages = [parse("<div><p>x</p><p>y</p><i>same</i></div>"), parse("<div><p>z</p><hr><i>same</i></div>")]
    (div,) = align(*map(generalise, pages))
    keys = {x[KEY]: x for x in div[ITEMS]}
    assert keys["p"][REPEATED] and keys["hr"][OPTIONAL] and not keys["i"][OPTIONAL]
    places = add_places(*(places_of(p, boilerplate(p)) for p in pages))[BELOW]["div"][BELOW]
    assert len(places["i"][FIXED]) == 1 and not places["p"][FIXED]
    (group,) = generalise(parse("<div>" + "<h2>a</h2><p>b</p>" * 500 + "</div>"))
    assert [x[KEY] for x in group[ITEMS]] == ["h2", "p"]


def test_alignment_is_the_same_at_any_size(monkeypatch):
    import random

    rng = random.Random(1)
    for n, m in [(0, 0), (0, 5), (1, 1), (30, 40), (60, 7)]:
        a, b = ([rng.choice("abcdef") for _ in range(k)] for k in (n, m))
        whole = matched(a, b)
        monkeypatch.setattr(wrappers, "CELLS", 0)
        assert matched(a, b) == whole
        monkeypatch.undo()
        assert [i for i, _ in whole if i is not None] == list(range(n)) and [j for _, j in whole if j is not None] == list(range(m))
        assert all(a[i] == b[j] for i, j in whole if i is not None and j is not None)


STORY = "<p>A story of some length, told in one go.</p>"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='content with-sidebar'><p>story</p></div>", "story"),
        ("<div class='has-banner'><article><p>story</p></article></div>", "story"),
        ("<div class='page no-sidebar'><main><p>story</p></main></div>", "story"),
        ("<div class='sidebar'><article><p>story</p></article></div><div class='sidebar'>no</div>", "story"),
        (f"<div class='menu'>{STORY}</div><div class='menu'><a>x</a></div>", "A story of some length, told in one go."),
        (f"<article>{STORY}<div class='share-price'>12.50</div><h2 class='menu-title'>Soups</h2></article>", "A story of some length, told in one go.\n12.50\nSoups"),
        (f"<article>{STORY}<div class='pull-quote social'>A quote</div><div class='share-bar'>Share</div><div class='ad top'>Buy</div></article>", "A story of some length, told in one go.\nA quote"),
        (f"<article>{STORY}<section class='comments area'><article class='comment'><p>{'I think so too. ' * 30}</p></article></section></article>", "A story of some length, told in one go."),
        (f"<article>{STORY}</article><ol class='comment-list'><li><article><p>{'me too ' * 50}</p></article></ol>", "A story of some length, told in one go."),
        (f"<article><header><h1>Head</h1></header>{STORY}<nav>n</nav><aside>a</aside><form>f</form></article>", "Head\nA story of some length, told in one go."),
        ("<article>" + "<div>" * 150 + "<p>deep</p><nav>Menu</nav><p>down</p>" + "</div>" * 150 + "<p>end</p></article><p>after</p>", "deep\ndown\nend"),
        ("<div>" * 150 + "<article><p>deep</p></article>" + "</div>" * 150 + "<div>after the article there is some more text</div>", "deep"),
    ],
)
def test_ordinary_pages(spark, page, text):
    assert run(spark, [("https://a.example/", page)])[0] == text


def test_headings_that_pages_share_stay(spark):
    page = "<body><nav>Menu</nav><article><h1>{0}</h1><h2>Ingredients</h2><ul><li>{0} water</ul><h2>Method</h2><p>Cook {1} minutes</p><table><tr><th>Time</th><td>{1}</td></tr></table><p>Rate this recipe</p></article></body>"
    names = ["Soup", "Tea", "Stew", "Rice", "Punch"]
    got = run(spark, [(f"https://cook.example/{i}", page.format(n, i)) for i, n in enumerate(names)])
    assert [got[i] for i in range(5)] == [f"{n}\nIngredients\n{n} water\nMethod\nCook {i} minutes\nTime\n{i}" for i, n in enumerate(names)]


def test_texts_do_not_depend_on_how_pages_are_dealt(spark):
    import random

    rng, rows = random.Random(3), []
    for host in range(25):
        for k in range(12):
            blocks = [rng.choice([f"<p>Line {rng.randrange(4)}</p>", "<ul><li>a<li>b</ul>", f"<div class='x{rng.randrange(3)}'><p>Part {rng.randrange(9)}</p></div>", "<hr>", f"<p>{k} of {host}</p>"]) for _ in range(rng.randrange(1, 7))]
            rows.append((host * 100 + k, f"https://h{host}.example/{k}", f"<body><div>{''.join(blocks)}</div><div>foot</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [{r["page_id"]: r["text"] for r in main_text(df.repartition(n, F.rand(n))).collect()} for n in (1, 3, 5)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 300


def test_large_wrappers_meet_pages_in_a_join(spark, monkeypatch):
    rows = [(i, f"https://h{i % 3}.example/", PAGE % f"<article><p>Text {i}</p><p>Join us</p></article>", "h", "w") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string")
    sent = sorted(map(tuple, main_text(df).collect()))
    monkeypatch.setattr(wrappers, "SEND_BYTES", 0)
    assert sorted(map(tuple, main_text(df).collect())) == sent
    assert [r[1:] for r in sent][0] == ("https://h0.example/", "h", "w", "Text 0") and main_text(df).columns == ["page_id", "url", "host", "wrapper", "text"]


@pytest.mark.parametrize("page", ["<div>" * 5000 + "x", "<" * 5000, "<p class='" + "a" * 5000 + "<p>x", "<article>" + "<h2>a</h2><p>b</p>" * 3000, "&#0; &bad; <a b=c <p>", "<script>never closed"])
def test_broken_pages_do_not_crash(spark, page):
    assert run(spark, [("https://a.example/", page)])[0] is not None


def test_op7_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in op7_main_text(spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages:
        body = re.search("<article>(.*)</article>", r["html"] or "", re.S)
        parts = re.split("</?(?:p|h1)>", body[1] if body else "")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_empty_pages(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def check_shards(rows, total, shards):
    counts = Counter(r["shard"] for r in rows)
    assert sum(counts.values()) == total and max(counts.values()) - min([counts.get(k, 0) for k in range(shards)]) <= 1
    for k in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))


def test_shards_mix_sources(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit("t").alias("text"), F.lit(1).alias("rank"))
    rows = stratified_shards(docs, shards=10).collect()
    check_shards(rows, 1000, 10)
    whole = Counter(r["source"] for r in rows)
    for k in range(10):
        own = Counter(r["source"] for r in rows if r["shard"] == k)
        assert all(abs(own[s] - Fraction(n, 10)) <= 2 for s, n in whole.items())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in stratified_shards(docs.repartition(5), shards=10).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    other = {r["doc_id"]: r["shard"] for r in stratified_shards(docs, shards=10, seed=1).collect()}
    assert other != {r["doc_id"]: r["shard"] for r in rows}


def test_shard_edge_cases(spark, edge):
    check_shards(stratified_shards(edge, shards=4).collect(), edge.count(), 4)
    assert stratified_shards(edge.limit(0)).count() == 0


def test_shard_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = scratch_path(spark, "shards")
    write_shards(docs, stratified_shards(docs, shards=3), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 3 and spark.read.parquet(path).count() == docs.count()


@pytest.mark.parametrize("ids", [[1, 2, None], [1, 2, 2]])
def test_shard_files_need_keys(spark, ids):
    docs = spark.createDataFrame([(i, "s", "t") for i in ids], "doc_id long, source string, text string")
    path = scratch_path(spark, "shards")
    with pytest.raises(ValueError):
        write_shards(docs, stratified_shards(docs, shards=2), path)


def test_op8_whole_table(spark, sf):
    import zlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_shards(spark, sf).collect()
    check_shards(rows, len(texts), 24)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]), "rows", None) for r in rows)
