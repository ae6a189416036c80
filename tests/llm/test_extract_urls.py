from plotweave.llm import extract as X
from plotweave.llm import urls as U


def page(title, body, host="h.example", nav="Home | About"):
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><div>Site</div></header><nav><ul><li><a href=/>{nav}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>{title}</h1><p class="hint">Subscribe to read on</p>{body}</article>
<aside>More</aside><form><p>Mail</p></form><div id="comments"><p>First!</p></div><footer>&copy; {host}</footer></body></html>"""


def test_article_without_template_and_marked_parts(spark):
    rows = [(k, f"http://h.example/{k}", page(f"Title {k}", f"<p>One &amp; <b>two</b>\n {k}<br>three<p>Last &lt;{k}&gt;")) for k in range(8)]
    rows += [(100, "http://lone.example/", page("Lone", "<p>Text")), (101, None, "<p>plain <i>words</i></p>and more"), (102, "http://h.example/x", None), (103, "http://h.example/y", ""), (104, "http://lone2.example", "a < b <unclosed"), (0, "http://h.example/0", page("Twice", "<p>again</p>"))]
    got = {}
    for r in X.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[3] == ["Title 3\nOne & two 3 three\nLast <3>"], "what most pages of the host have in one slot is template"
    assert sorted(got[0]) == ["Title 0\nOne & two 0 three\nLast <0>", "Twice\nagain"]
    assert got[100] == ["Lone\nSubscribe to read on\nText"], "one page shows no template"
    assert got[101] == ["plain words\nand more"] and got[102] == [""] and got[103] == [""]
    assert X.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def soup(k, words):
    """A page without telling names: constant and varying parts around an article of its own."""
    own = [f"{w}{k}" for w in words]
    body = "".join(f"<div class=q4>{' '.join(own[i : i + 12])}</div>" for i in range(0, 60, 12))
    return f"<html><body><div class=z1><div>Start</div><div>All</div></div><div class=k9><div class=t2>Head {own[0]}</div>{body}<div class=q4>Set in print by us</div></div><div class=m3>{own[1]} {own[2]}</div><div class=z7>Made by us</div></body></html>", "\n".join([f"Head {own[0]}", *(" ".join(own[i : i + 12]) for i in range(0, 60, 12))])


def test_parts_without_names_are_told_by_what_varies(spark):
    import random

    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    pages = [(k, f"http://soup.example/{k}", soup(k, words)[0]) for k in range(6)]
    pages += [(100 + k, "http://soup.example/0", soup(0, words)[0]) for k in range(30)]
    got = {r["page_id"]: r for r in X.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k]["text"] == soup(k, words)[1] for k in range(6)), "constant texts and small varying parts are no content"
    assert all(got[100 + k]["text"] == soup(0, words)[1] for k in range(30)), "copies of a page are no template"
    assert got[3]["template_blocks"] == 1


def test_siblings_that_differ_in_id_or_hidden(spark):
    html = "<body><div id=nav>menu</div><div id=content><p hidden>not this</p><p>The words.</p></div><div id=comments>First!</div></body>"
    got = X.main_text(spark.createDataFrame([(1, "http://a.b/", html), (2, None, html)], "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == ["The words."] * 2


def read(spark, rows):
    return {r["page_id"]: r["text"] for r in X.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


ARTICLE = "".join(f"<p>Sentence {k} of the one article that this host has, in a few words.</p>" for k in range(8))
ARTICLE_TEXT = "\n".join(f"Sentence {k} of the one article that this host has, in a few words." for k in range(8))


def test_near_copies_of_one_article_stay(spark):
    around = lambda k: f"<body><nav>Menu {k}</nav><article>{ARTICLE}{'<p>Late news.</p>' if k == 4 else ''}</article><footer>Foot {k}</footer></body>"
    for n in (2, 3, 6):
        got = read(spark, [(k, f"http://copies{n}.example/{k}", around(k)) for k in range(n)])
        assert got == {k: ARTICLE_TEXT + ("\nLate news." if k == 4 else "") for k in range(n)}


def test_class_words_within_the_article(spark):
    body = lambda k: "".join(f"<p>Page {k} says something of its own in line {i}, at some length.</p>" for i in range(6))
    inside = '<div class="social history">On social history.</div><section class="share-prices">Prices went up.</section><div class="share-buttons">Share</div><div class="ad">Buy</div><ul class="comment-list"><li>First!</li></ul>'
    rows = [(k, f"http://words.example/{k}", f"<body><nav>Menu</nav><article>{body(k)}{inside.replace('.<', f' {k}.<')}</article></body>") for k in range(4)]
    got = read(spark, rows)
    assert all(got[k].split("\n")[6:] == [f"On social history {k}.", f"Prices went up {k}."] for k in range(4))


def test_marks_below_the_greatest_depth(spark):
    html = "<body><article>" + "<div>" * 120 + "<p>Told.</p><nav>Menu</nav><div class=comments><p>First!</p></div><p hidden>no</p><p>Told on.</p>" + "</div>" * 120 + "</article></body>"
    assert read(spark, [(1, "http://deep.example/", html), (2, None, html)]) == {1: "Told.\nTold on.", 2: "Told.\nTold on."}


def test_class_names_with_numbers_are_one_node(spark):
    rows = [(k, f"http://ids.example/{k}", f"<body><div id=menu{k}>Menu {k}</div><div class='post post-{k} x{k + 1000}y'><p>Text number {k} of this host, long enough to be it.</p></div></body>") for k in range(40)]
    assert read(spark, rows) == {k: f"Text number {k} of this host, long enough to be it." for k in range(40)}
    trees = {X._as_text(X.as_lists(X.parse(h)[0])) for _, _, h in rows}
    assert len(trees) == 1


def plain_wrapper(pages):
    """What the contract asks of made pages: the blocks of the article, in order."""
    return {k: "\n".join(lines) for k, lines, _ in pages}


def test_random_hosts_against_what_they_were_made_of(spark):
    import random

    rng = random.Random(11)
    sentence = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(6, 25)))
    pages = []
    for host in range(8):
        nested = rng.randint(0, 5)
        box = rng.choice(["<div class=c{0}>", "<section class='k{0} wide'>", "<article>"]).format(host)
        end = {"<d": "</div>", "<s": "</section>", "<a": "</article>"}[box[:2]]
        for k in range(rng.randint(1, 9)):
            lines = [sentence() for _ in range(rng.randint(5, 15))]
            top, bottom = f"<ul class=nav-list><li>{sentence()}</li></ul>", f"<footer><p>{sentence()}</p></footer>"
            ads = f"<div class='ad-box'><p>{sentence()}</p></div>"
            html = f"<html><body>{top}<div>{'<div>' * nested}{box}{''.join(f'<p>{x}</p>' for x in lines[:3])}{ads}{''.join(f'<p>{x}</p>' for x in lines[3:])}{end}{'</div>' * nested}</div>{bottom}</body></html>"
            pages.append((100 * host + k, lines, (f"http://h{host}.example/{k}", html)))
    assert read(spark, [(k, *row) for k, _, row in pages]) == plain_wrapper(pages)


def test_deep_and_broken_markup(spark):
    deep = "<div>" * 100_000 + "Deep down" + "</div>" * 100_000
    inline = "<i>" * 50_000 + "<p>One" * 50
    rows = [(1, "http://d.e/1", deep), (2, "http://d.e/2", inline), (3, "http://d.e/3", "</p></x>" * 1000 + "<math><mi>x</mi></math> &amp;lt; <svg><title>no</title></svg>y"), (4, "http://d.e/4", "<p" * 1000)]
    got = {r["page_id"]: r["text"] for r in X.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Deep down" and got[2].split() == ["One"] * 50 and got[3] == "x &lt; y"


def test_tree_matching_and_merge():
    tree = lambda label, *children: [label, 0, 0, 0, list(children)]
    a = tree("r", tree("nav"), tree("p", tree("b")), tree("div"))
    b = tree("r", tree("p", tree("b")), tree("aside"), tree("div"))
    assert X.matching(a, b) == (4, [(1, 0), (2, 2)])
    assert [c[0] for c in X.merge(a, b)[4]] == ["nav", "p", "aside", "div"]
    assert X.matching(tree("x"), tree("y")) == (0, [])


def test_url_parts_rules_and_walks(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="http://{h}/">x</a>' for h in hosts)
    rows = [
        (1, "http://WWW.Example.com/en/1?q#f", ""), (2, "https://example.com/en/", ""), (3, "https://a.example.com/de/", None), (4, "http://x.net/es/1", ""), (5, "http://x.net/de/", link("y.org")),
        (6, "http://y.org/", link("x.net")), (7, "http://z.org/", link("good.com")), (8, None, ""), (9, "no scheme", ""), (10, "http://host?x=1", ""), (11, "http://bad.net/fr/", link("y.org")), (12, "http://fan.org/", link("bad.net", "bad.net")), (13, "http://good.com/", link("z.org")),
    ]
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    got = {r["page_id"]: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    parts = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()}
    assert parts[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert parts[2] == ("example.com", "/en/", "example.com/en/", "block") and parts[3][2:] == ("com/", "allow")
    assert parts[4][2:] == ("net/es/", "block") and parts[5][2] is None
    assert parts[8] == ("", "", None, "allow") and parts[9] == ("", "", None, "allow") and parts[10][:2] == ("host", "")
    assert parts[12][3] == "block", "all of its links go to a blocked host"
    assert got[7]["trust"] > 0 and parts[7][3] == "allow" and got[12]["distrust"] > got[12]["trust"]
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_hosts_in_a_circle_and_what_is_no_link(spark):
    to = lambda h: f'<a href="//{h}/x">x</a>'
    rows = [(1, "http://one.org/", to("two.org")), (2, "http://two.org/", to("three.org")), (3, "http://three.org/", to("one.org") + to("x.net") + to("x.net") + to("x.net")), (4, "http://x.net/es/", to("one.org"))]
    rows += [(5, "http://quiet.org/", f'<a data-href="http://x.net/">n</a><!-- {to("x.net")} --><script>"{to("x.net")}"</script><!-- {to("x.net")}')]
    got = {r["page_id"]: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), [("block", "net", "/es/")]).collect()}
    # The circle sends distrust round: three gets all of x's, two and one what is left of it.
    assert got[3]["distrust"] > got[2]["distrust"] > got[1]["distrust"] > 0 and got[5]["distrust"] == 0
    assert [got[k]["verdict"] for k in (1, 2, 3, 4, 5)] == ["block", "block", "block", "block", "allow"]


def test_walks_against_plain_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3)]
    got = {r["host"]: r for r in U.spread(spark.createDataFrame(edges, "source string, target string, links long"), spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 0.5)], "host string, trusted double, blocked double"), close=1e-5).collect()}
    t, d = {"a": 1.0, "b": 0.0, "c": 0.0}, {"a": 0.0, "b": 0.0, "c": 0.5}
    seed_t, seed_d = dict(t), dict(d)
    out, into = {"a": 3, "b": 1, "c": 3}, {"a": 3, "b": 2, "c": 2}
    for _ in range(400):
        t = {h: seed_t[h] + 0.85 * sum(t[s] * n / out[s] for s, x, n in edges if x == h) for h in t}
        d = {h: seed_d[h] + 0.85 * sum(d[x] * n / into[x] for s, x, n in edges if s == h) for h in d}
    assert all(abs(got[h]["trust"] - t[h]) < 1e-3 and abs(got[h]["distrust"] - d[h]) < 1e-3 for h in t)
