import html
import re

from pyspark.sql import functions as F

from lagscope.llm import wrapper as W
from tests.llm.helpers import clashing, table

SCHEMA = "page_id bigint, url string, html string"


def article(source):
    a = source[source.index("<article>"):source.index("</article>")]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", a))).split())


def test_tables_against_their_articles(spark):
    for sf in ("sf0.001", "sf0.01"):
        pages = table(spark, "pages", sf)
        want = sorted((r.page_id, r.url, article(r.html)) for r in pages.collect())
        got = W.op3(pages).collect()
        assert sorted((r.page_id, r.url, r.text) for r in got) == want
        assert all(r.n_chars == len(r.text) for r in got)


def page(k, body):
    return (f"<html><head><title>T{k}</title><style>a{{}}</style></head><body><header><h1>Site {k}</h1></header>"
            f"<nav><a href=x>Home {k}</a></nav><div class='cookie-notice'>We use cookies {k}</div>{body}"
            f"<aside>side {k}</aside><section id='userComments'><article class=comment><p>nice {k}</p></article></section>"
            f"<footer>foot {k}</footer><script>if(a<b)x='</p>{k}'</script></body></html>")


def test_slots_of_a_host_without_an_article(spark):
    rows = [(k, f"http://h.example/{k}", page(k, (
        f'<div id="wrap"><div class="content post-{k}"><h1>Title {k} &amp; more</h1><p>Para <b>one</b>{k}<i>x</i>.'
        f'<p>Second&#32;para {k}<br>line<ul><li>a{k}<li>b</ul><p class="license">All rights reserved</p>'
        f'<form>subscribe {k}<input></form></div><div class="social">share {k}</div></div>')))
        for k in range(8)]
    got = {r.page_id: r.text for r in W.op3(spark.createDataFrame(rows, SCHEMA)).collect()}
    # the constant license line is template, the varying rest of the container is content
    assert got == {k: f"Title {k} & more Para one{k}x. Second para {k} line a{k} b" for k in range(8)}


def test_hosts_alike_small_or_odd(spark):
    same = page(1, "<main><h2>Head</h2><p>Body text</p></main>")
    rows = ([(k, "https://same.example:8080/x", same) for k in range(7)]
            + [(20, "http://one.example/", page(2, "<article><h1>A</h1><p>B&lt;C</p></article>"))]
            + [(30, None, None), (31, "bad url", ""), (32, "", " \n "), (None, "http://z/1", "plain &amp; simple"),
               (33, "http://y/2", "<p>" * 300 + "deep</div>"), (34, "http://x/3", "<div>" * 400 + "deep" + "</div>" * 20),
               (34, "http://x/3", "<div>" * 400 + "deep" + "</div>" * 20), (35, "http://w/4", "a <b>b</b>c<!-- no -->d<"),
               (36, "http://v/5", "<p title='>'>x</p><p>" + "long words " * 50_000)])
    pages = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.page_id, r.text) for r in W.op3(clashing(pages)).collect()), key=repr)
    want = ([(k, "Head Body text") for k in range(7)]
            + [(20, "A B<C"), (30, ""), (31, ""), (32, ""), (None, "plain & simple"), (33, "deep"), (34, "deep"), (34, "deep"),
               (35, "a bcd<"), (36, "x " + "long words " * 49_999 + "long words")])
    assert got == sorted(want, key=repr)
    assert W.op3(pages.limit(0)).count() == 0


def test_many_partitions_give_one_wrapper(spark):
    pages = table(spark, "pages", "sf0.01").withColumn("url", F.lit("http://hot.example/"))
    one = sorted(map(tuple, W.wrappers(pages.coalesce(1)).collect()))
    many = sorted(map(tuple, W.wrappers(pages.repartition(40)).collect()))
    assert one == many and len(one) == 1


def test_simple_tree_matching():
    leaf = lambda x, *c: [x, False, 1, 0, 0, list(c)]
    a = leaf("r", leaf("p"), leaf("q", leaf("s"), leaf("t")), leaf("u"))
    b = leaf("r", leaf("q", leaf("t")), leaf("p"), leaf("u"))
    assert W.matching(a, b) == 4     # r, q, t, u: p stands out of order
    both = W.align(a, b)
    assert [x[0] for x in both[5]] == ["p", "q", "u"] and [x[2] for x in both[5]] == [2, 2, 2]


def test_template_is_counted_in_different_pages(spark):
    # one article alone has the list; it stands at six urls, its furniture varies
    copies = [(k, f"http://c.example/0?print={k}", page(k, "<main><p>Text 0</p><ul><li>own item</ul></main>"))
              for k in range(6)]
    others = [(k, f"http://c.example/{k}", page(k, f"<main><p>Text {k}</p></main>")) for k in range(6, 12)]
    # three pages: a constant line and a constant heading are template from two on
    few = [(k, f"http://d.example/{k}", page(k, f'<main><h2>Read this</h2><p>Body {k}</p><div class="legal">Rights</div>'
                                             "</main>")) for k in range(20, 23)]
    got = {r.page_id: r.text for r in W.op3(spark.createDataFrame(copies + others + few, SCHEMA)).collect()}
    assert got == ({k: "Text 0 own item" for k in range(6)} | {k: f"Text {k}" for k in range(6, 12)}
                   | {k: f"Body {k}" for k in range(20, 23)})


def texts_of(spark, pages):
    rows = [(k, f"http://e.example/{k}", body) for k, body in enumerate(pages)]
    return [r.text for r in sorted(W.op3(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.page_id)]


def test_only_alignment_tells_template_from_content(spark):
    # no class, no furniture element: a constant paragraph and an advert among varying siblings
    assert texts_of(spark, [f"<p>Body {k}</p><p>All rights reserved</p><div>Buy now!</div><div>Second {k}</div>"
                            for k in range(10)]) == [f"Body {k} Second {k}" for k in range(10)]
    # as many paragraphs as the page has; the notice stands before the last one, and not on every page
    def body(k, notice):
        paras = [f"Para {k} {i}" for i in range(1 + k % 5)]
        return paras[:-1] + ["Read our terms"] * notice + paras[-1:]
    pages = [body(k, k % 4 != 1) for k in range(24)]
    want = [" ".join(p for p in page if p.startswith("Para")) for page in pages]
    assert texts_of(spark, ["<div>" + "".join(f"<p>{p}</p>" for p in page) + "</div>" for page in pages]) == want
    # a line that half of the pages or fewer share is content
    lines = [["own " + str(k), "shared"] if k % 3 == 0 else ["own " + str(k)] for k in range(12)]
    assert texts_of(spark, ["<ul>" + "".join(f"<li>{x}" for x in page) + "</ul>" for page in lines]) == [
        " ".join(page) for page in lines]
    # list items hold a constant label each
    items = [[f"item {k} {i}" for i in range(2 + k % 3)] for k in range(9)]
    assert texts_of(spark, ["".join(f"<div><h3>Offer</h3><p>{x}</p></div>" for x in page) for page in items]) == [
        " ".join(page) for page in items]


def test_folding_does_not_depend_on_the_order():
    import itertools
    sources = [f"<h1>T{k}</h1>" + "".join(f"<p>a{k}.{i}</p>" for i in range(k)) + "<p>fixed</p>" + f"<p>z{k}</p>" * (k % 2)
               for k in range(5)]
    for order in itertools.permutations(range(5)):
        tree = None
        for k in order:
            one = W.tree_of(W.Page(sources[k]))
            tree = one if tree is None else W.align(tree, one)
        wrapper = W.json.dumps(W.wrapper_of(tree))
        for k in range(5):
            want = [f"T{k}", *(f"a{k}.{i}" for i in range(k)), *[f"z{k}"] * (k % 2)]
            assert W.main_text(sources[k], wrapper).split() == want, order


def test_slug_ids_do_not_grow_the_tree():
    def size(n):
        tree = None
        for k in range(n):
            word = "".join(chr(97 + int(d)) for d in str(k))
            paras = "".join(f"<p>text {k} {i}</p>" for i in range(k * 7 % 11))
            one = W.tree_of(W.Page(f"<div id='post-{word}' class='post post-{word}'><h1 id={word}>T {k}</h1>{paras}</div>"))
            tree = one if tree is None else W.align(tree, one)
        def nodes(t):
            return 1 + sum(map(nodes, t[5]))
        return nodes(tree)
    assert size(50) == size(200) == size(800) <= 20


def test_hostile_pages_take_linear_time():
    import time
    empty = W.json.dumps(W.wrapper_of(W.tree_of(W.Page("x"))))
    n = 100_000
    for source in ("<div>" * n + "deep", "<b>" * n + "x<br>" * 1000 + "deep", "<b><br>" * n + "deep",
                   "<div>" + "<b>" * n + "</i></div></b>" * 1000 + "deep", "<a><div>" + "<b>" * n + "</a>" * n + "deep",
                   "<head>" * n + "<body>deep", "<a '>' \"" * 20_000 + ">deep", "<scripx <style></style " * 20_000 + ">deep",
                   "<p>x</p>" * n + "deep", "<div><i>x</i><div>y</div></div>" * 30_000 + "deep"):
        start = time.perf_counter()
        assert W.main_text(source, empty).endswith("deep")
        a, b = W.tree_of(W.Page(source)), W.tree_of(W.Page(source + "<p>more"))
        assert W.align(a, b)[2] == 2
        assert time.perf_counter() - start < 10, source[:40]


def test_elements_below_the_deepest_keep_their_furniture():
    source = "<div>" * 80 + "<p>text</p><nav><ul><li>menu</li></ul></nav>" + "</div>" * 80
    wrapper = W.json.dumps(W.wrapper_of(W.tree_of(W.Page(source))))
    assert W.main_text(source, wrapper) == "text"


def test_matching_is_one_rule_for_trees_of_any_size(spark):
    # the first line of one page is the last of the other: all others pair, however many
    for n in (20, 600):
        lines = [f"<p>line {i}</p>" for i in range(n)]
        a, b = (W.tree_of(W.Page("".join(x))) for x in (["<p>moved</p>", *lines], [*lines, "<p>moved</p>"]))
        assert W.matching(a, b) == 1 + n * (1 + W.SAME_TEXT)
        assert [x[2] for x in W.align(a, b)[5][:-1]].count(2) == n
    # shared lines are template on a host of long pages as on one of short pages
    for n in (5, 500):
        shared = [f"shared {i}" for i in range(n)]
        pages = [["last moved"] * (k == 0) + shared + [f"own {k}"] + ["last moved"] * (k > 0) for k in range(6)]
        got = texts_of(spark, ["".join(f"<p>{x}</p>" for x in page) for page in pages])
        assert got == ["last moved " * (k == 0) + f"own {k}" for k in range(6)], n


def test_small_and_large_trees_are_matched_alike(monkeypatch):
    import random
    rng = random.Random(3)

    def body(depth):
        return "".join(f"<{t}>{rng.choice(['', 'x', 'y', 'z' + str(rng.randrange(4))])}"
                       f"{body(depth - 1) if depth and rng.random() < .6 else ''}</{t}>"
                       for t in rng.choices(["p", "div", "ul"], k=rng.randrange(1, 7)))

    for _ in range(100):
        trees = [W.tree_of(W.Page(body(rng.randrange(1, 4)))) for _ in range(5)]
        folded = []
        for small in (0, 1 << 60):
            monkeypatch.setattr(W, "SMALL", small)
            tree, steps = trees[0], []
            for x in trees[1:]:
                steps.append(W._match(tree, x, W._Work()))
                tree = W.align(tree, x)
            folded.append((steps, W.wrapper_of(tree)))
        assert folded[0] == folded[1]


def test_long_tables_of_different_rows_are_matched_whole():
    import time
    a, b = (W.tree_of(W.Page("<table>" + "".join(f"<tr><td>{k} {i}</td><td>{i % 7}</td><td>yes</td></tr>" for i in range(1000))
                             + "</table>")) for k in (1, 2))
    start = time.perf_counter()
    assert W.matching(a, b) == 2 + 1000 * (1 + 2 * (1 + W.SAME_TEXT))
    assert time.perf_counter() - start < 10
