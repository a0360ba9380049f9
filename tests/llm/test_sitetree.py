"""Site style trees on layout classes and on hosts with many copies."""

import random
from collections import Counter
from math import log

from kindred.llm import sitetree


def text(page):
    return sitetree.main_text(sitetree.parse(page))


def test_layout_words_keep_the_page():
    for c in ("content-area has-sidebar", "wrap no-sidebar", "site with-nav", "widget"):
        assert text(f"<body><div class='{c}'><article>own text</article></div></body>") == "own text"
        assert text(f"<body><div id=a class='{c}'><p>own text of the page</p></div><div class='share-box'>share</div></body>") == "own text of the page"
    assert text("<body><div class='main-nav'>x</div><p>own text</p><div class='wrap sidebar'>y</div></body>") == "own text"


def test_copies_count_once(spark):
    copy = "<html><body><div>Site name</div><p>copied text</p></body></html>"
    rows = [(i, f"http://h/{i}", copy) for i in range(90)] + [(100 + i, f"http://h/{i}", f"<html><body><div>Site name</div><p>own {i}</p></body></html>") for i in range(10)]
    got = {r["id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "copied text" for i in range(90)} | {100 + i: f"own {i}" for i in range(10)}


def test_no_page_loses_all_its_text():
    tree = sitetree.parse("<html><body><div>only</div></body></html>")
    paths = {n.path for n in sitetree._inner(tree)}
    assert sitetree.main_text(tree, paths) == "only"
    tree = sitetree.parse("<html><body><div class=m>menu</div><article><h2>a</h2><p>the long text of the whole article</p></article></body></html>")
    assert sitetree.main_text(tree, {n.path for n in sitetree._inner(tree)}) == "the long text of the whole article"


def site(n: int = 100) -> list[tuple[int, str, str]]:
    """Pages with a rotating menu, a rotating advert and an author box, in elements without a role, the box in the article."""
    r = random.Random(3)
    say = lambda k: " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(k))
    items, adverts = [say(1) for _ in range(15)], [say(9) for _ in range(5)]
    rows = []
    for i in range(n):
        menu = "".join(f"<span>{x}</span>" for x in r.sample(items, r.randint(5, 7)))
        own = [f"{say(20)}, {say(5)}. {say(9)}" for _ in range(r.randint(2, 6))]
        page = f"<body><div class=top>{menu}</div><div class=x1>{r.choice(adverts)}</div><article><h1>{say(4)}</h1>{''.join(f'<p>{p}</p>' for p in own)}<div class=who>By the desk, all rights kept</div></article></body>"
        rows.append((i, page, own))
    return rows


def test_rotating_boilerplate_without_roles_goes(spark):
    rows = site()
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h, _ in rows], "page_id long, url string, html string")
    got = {r["id"]: r["text"].split("\n") for r in sitetree.extract(pages).collect()}
    assert {i: t[1:] for i, t in got.items()} == {i: own for i, _, own in rows}  # after each page's heading
    few = {r["id"]: r["text"] for r in sitetree.extract(pages.where("page_id < 3")).collect()}
    assert all("By the desk" in t for t in few.values())  # three pages are no evidence


def test_importances_equal_brute_force(spark):
    rows = site(30) + site(30)[:7]  # seven copies count once
    rows += [(i, h.replace("<body>", "<body><div class=top><b>Home</b></div>") if i % 2 else h, o) for i, h, o in site(9)]
    pages = spark.createDataFrame([(i % 2, h) for i, h, _ in rows], "host int, html string").selectExpr("string(host) host", "html")
    want: dict = {}
    for host in (0, 1):
        own = {h for i, h, _ in rows if i % 2 == host}
        phrases, styles, ups = Counter(), Counter(), {}
        for h in own:
            for path, kind, code, up in sitetree.styles(sitetree.parse(h)):
                (styles if kind else phrases)[path, code] += 1
                if kind:
                    ups[path] = up
        m = Counter()
        for (path, _), k in styles.items():
            m[path] += k
        for branch in ups:
            ends = [log(k) / log(m[p] + sitetree.PRIOR) for (p, _), k in phrases.items() if branch in ups[p]]
            spread = [k / m[branch] for (p, _), k in styles.items() if p == branch]
            if ends:
                style = -sum(p * log(p) for p in spread) / log(m[branch] + sitetree.PRIOR)
                want[host, branch] = m[branch], round(max(style, 1 - sum(ends) / len(ends)), 9)
    for broadcast in (-1, 1000):
        got = sitetree.importances(pages, broadcast=broadcast).join(pages.selectExpr("host name", "xxhash64(host) host").distinct(), "host").collect()
        assert {(int(r["name"]), r["path"]): (r["pages"], round(r["importance"], 9)) for r in got} == want


def test_reader_comments_go():
    own = "<article>own</article>"
    for page in (
        own + '<section class="comments"><article class="comment-body">reader says</article></section>',
        '<article>own<section class="comments"><article class="comment-body">reader says</article></section></article>',
        own + '<article class="comment">reader says</article><article id="comment-7">so it is</article>',
        "<main><p>own</p></main><div id=disqus_thread>" + "reader says " * 99 + "</div>",
        own + "<ol class=commentlist><li>" + "reader says " * 99 + "</li></ol>",
        '<article>own<div itemprop="comment">reader says</div><div itemscope itemtype="https://schema.org/Comment">too</div></article>',
        "<body><p>own</p><div class='comments-area'>" + "r" * 10 + "</div></body>",
    ):
        assert text(page) == "own", page
    for page in ("<div class=comments-open><article>own</article></div>", "<div class=has-comments><article>own</article></div>", "<body class='comments'><p>own</p></body>", "<div class=comments>own</div>"):
        assert text(page) == "own", page


def test_stray_quotes_end_no_text():
    assert text('<p title="x"">first part</p>') == "first part"
    assert text("<p class=it's>first don't stop</p><p>second</p><p>it's third</p>") == "first don't stop\nsecond\nit's third"
    assert text("<p a='1'b=\"2\"'>x</p><p =x = y>z</p><p a= >w</p></ b></>end") == "x\nz\nw\nend"
    assert text("<p title='class=ad menu' data-x=\"a>b\">x</p>") == "x"  # what looks like an attribute in a value is none
    assert text("<p class=a class=sidebar>long text</p>") == "long text"
    assert text("<p>a</p><p title=\"never ends>b</p>") == "a"
    assert text("<p/>a<br/>b<div/>c") == "a b\nc"


def test_time_grows_with_the_page():
    from time import process_time

    n = 40_000
    for page in (
        "<span><p>x" * n, "<div>" + "</b>" * (6 * n), "<div></b>" * n, "<li><ul>" + "<span>" * n + "<li>x</li>" * n, "<article>" * n + "x", "<header><article>x" * n,
        "<p class=it's>x" * n, '<a b="' * n, "<div class=comments>x" * n, "<" * 10 * n, "<p a" + "=" * 10 * n, "<title>" * n, "<td><p>" * n,
    ):
        at = process_time()
        text(page)
        assert process_time() - at < 8 * len(page) / 1e6 + 1, page[:30]
