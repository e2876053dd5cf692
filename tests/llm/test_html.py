import random

from numeriq.llm.html_wrapper import aligned, extract_main_text, fold, mapping, match, parse, read_tree


def text_of(html):
    _, blocks = parse(html)
    inside = any(not hard and not mark and a for _, hard, mark, a, _ in blocks)
    return " ".join(t for _, hard, mark, a, t in blocks if not hard and not mark and (a or not inside))


def test_parse_keeps_the_article_only():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
    <body class="page comments-open"><header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a></ul></nav><!-- ad > 1 -->
    <div class="ad">Buy</div><div id=cookie-notice>We use cookies</div><main><article><header><h1>Head&shy;line &amp; more</h1></header>
    <p>One <b>bold</b> wo<i>rd</i>.<br>Next&nbsp;line<p title="a > b">Two<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>
    <aside>Related</aside><form><input><label>Name</label><button>Go</button></form><div class="newsletter-signup">Sign up</div>
    <section class="user-comments"><p>First!</p></section><pre>a
      b</pre></article></main><div class="sidebar">Side</div><footer>&copy; me</footer></body></html>"""
    assert text_of(page) == "Head\xadline & more One bold word. Next line Two x y 1 2 a b"


def test_parse_survives_anything():
    assert text_of("") == "" and text_of("plain  text &lt;b&gt;") == "plain text <b>" and text_of("<p>a<p>b") == "a b"
    assert text_of("<!-- open <p>x") == "" and text_of('<a title="x>y') == "y" and text_of("a < b <3 </ c") == "a < b <3 </ c"
    assert text_of("<head><meta x><p>body at once") == "body at once"
    assert text_of("<script>if (a</b) {}</script><textarea><p>no</textarea>yes<title>t</title>") == "yes"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000 + "<section>" * 500
    tree, blocks = parse(deep)
    assert [b[4] for b in blocks] == ["deep"] and fold([tree, tree]) and mapping(fold([tree]), tree)
    wide = "".join(f"<div class=c{i}><section>{i}</section></div>" for i in range(3000)) + "".join(f"<div class={'abcdefghij'[i % 10] * (i // 10 + 1)}>z</div>" for i in range(2000))
    tree, blocks = parse(wide)
    assert len(blocks) == 5000 and len(tree) < 40_000
    rng = random.Random(0)
    for _ in range(300):
        parse("".join(rng.choice(["<p", ">", "<div class='ad'>", "</div>", "text ", "<!--", "-->", '"', "'", "<li>", "</p>", "<article>", "&amp", "<td>", "</table>"]) for _ in range(40)))


def test_simple_tree_matching_aligns():
    a, b = read_tree("r 0(x 1,y 2(z 3),w 4)"), read_tree("r 0(y 1(z 2,v 3),q 4,w 5)")
    assert match(a, b, {}) == 4
    pairs = {(x.label, y.label) for x, y, _ in aligned(a, b) if x}
    assert pairs == {("r", "r"), ("y", "y"), ("z", "z"), ("w", "w")}
    t = fold(["r 0(x 1,y 2(z 3),w 4)", "r 0(y 1(z 2,v 3),q 4,w 5)"])
    assert -1 not in mapping(t, "r 0(x 1,y 2(z 3),w 4)") and -1 not in mapping(t, "r 0(y 1(z 2,v 3),q 4,w 5)")


def test_constant_slots_are_template(spark):
    rows = []
    for i in range(6):
        extra = "<div>Odd box</div>" if i % 2 else ""
        rows.append((i, f"http://h.example/p{i}", f"<body><div>Welcome to our site</div>{extra}<div><h1>Title {i}</h1><p>Body {i} words</p><p>See you soon, readers</p></div><div>All rights reserved</div></body>"))
    rows += [(10, "http://one.example/", "<body><p>Only page</p></body>"), (11, "http://two.example/a", "<p>Same</p>"), (12, "http://two.example/b", "<p>Same</p>"), (13, "http://two.example/c", "<p>Same</p>")]
    rows += [(14, None, "<p>No host</p>"), (15, "http://h.example/n", None), (16, "x", ""), (None, "http://one.example/", "<p>No id</p>"), (10, "http://one.example/", "<body><p>Only page</p></body>")]
    df = spark.createDataFrame([(*r, "z", "q") for r in rows], "page_id long, url string, html string, host string, text string")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in extract_main_text(df).collect()}
    for i in range(6):
        assert got[i, f"http://h.example/p{i}"][0] == f"Title {i} Body {i} words"
    assert got[10, "http://one.example/"] == ("Only page", 9) and {got[11 + i, f"http://two.example/{c}"][0] for i, c in enumerate("abc")} == {"Same"}
    assert got[14, None][0] == "No host" and got[15, "http://h.example/n"] == ("", 0) == got[16, "x"] and got[None, "http://one.example/"][0] == "No id"
    assert extract_main_text(df).count() == len(rows) and extract_main_text(df.limit(0)).count() == 0


def test_pages_of_the_tables(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r["page_id"]].split() == want.split()


def test_names_are_a_prior_only(spark):
    body = "<p>" + "Long words of the story. " * 9 + "</p>"
    story = "Long words of the story. " * 9
    pages = [
        ('<body><div class="content no-sidebar"><p>Hello</p></div></body>', "Hello"),
        ('<body><div class="search-results"><p>Hello</p></div></body>', "Hello"),
        (f'<body><h1>T</h1><div class="widget-area">{body}</div><div class="related">More</div></body>', "T " + story.strip()),
        ('<body><h1>T</h1><p>Short</p><div class="user-comments">' + body * 9 + "</div></body>", "T Short"),
        ('<body><article></article><div class="sidebar">Side</div></body>', ""),
        (f'<body><article><p>Short</p><div class="share">{body}</div></article><div class="sidebar">{body}</div></body>', "Short " + story.strip()),
        ('<body><div class="ad">Buy</div><footer>f</footer></body>', ""),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.example/", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    assert [got[i] for i in range(len(pages))] == [t for _, t in pages]


def test_neutral_names_without_articles(spark):
    """Constant, optional and pooled slots are dropped by induction alone; no element or class says what they are."""
    pool = ["Try our tea", "Try our soap", "Fly to Mars"]
    rows = []
    for i in range(30):
        note = "<section class=b>We moved house</section>" if i % 3 == 0 else ""
        rows.append((i, f"http://n.example/{i}", f"<body><div class=a>Our name</div>{note}<div class=c>{pool[i % 3]}</div><div class=d><h1>Head {i}</h1><p>Story {i} goes on</p><div class=e>{pool[(i + i // 3) % 3]}</div><p>and ends {i}</p></div><div class=f>Bye</div></body>"))
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i} Story {i} goes on and ends {i}" for i in range(30)}


def test_sections_beyond_the_bounds_are_counted(spark):
    """Constant text under sections that a tree or a template has no room for is template too."""
    rows = []
    for i in range(5):
        many = "".join(f"<div class={chr(97 + k // 26)}{chr(97 + k % 26)}><p>Fixed {k}</p></div>" for k in range(300))
        rows.append((i, f"http://w.example/{i}", f"<body>{many}<div class=zzz><p>Own {i}</p></div></body>"))
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own {i}" for i in range(5)}


def test_nested_pages_parse_in_linear_time():
    import time

    began = time.perf_counter()
    _, blocks = parse("<div>" * 20_000 + "<p>x</p></span>" * 2_000 + "</section>" * 2_000)
    assert len(blocks) == 2_000 and time.perf_counter() - began < 1.5


def test_no_name_takes_the_article(spark):
    """Sections that hold what varies stay whatever they are called; template is never taken instead."""
    def story(i):
        return " ".join(f"Sentence {i} {k} of a long story." for k in range(12))

    shapes = {
        "board": '<div class="top">Site menu home</div><div class="notice-board">{}</div><div class="foot">Copyright</div>',
        "adhoc": '<div class="top">Site menu home</div><div id="ad-hoc-networks">{}</div><div class="foot">Copyright</div>',
        "policy": '<div class="nav">Home</div><main><div class="comment-policy">{}</div></main>',
        "disclaimer": '<section class="disclaimer">{}</section><div class="nav">Home</div>',
        "form": '<form id="aspnetForm"><div class="top">Site menu</div><div class="body">{}</div><div class="foot">Copyright</div></form>',
        "formed": '<form id="aspnetForm"><div class="menu">Menu</div><article>{}</article><div class="x">Not this</div></form>',
        "ended": '<div class="top">Site</div><article>{}<p>The end.</p></article>',
    }
    rows = [(k * 100 + i, f"http://{name}.example/{i}", "<body>" + shape.format(f"<p>{story(i)}</p>") + "</body>") for k, (name, shape) in enumerate(shapes.items()) for i in range(4)]
    mirror = "<body><div>Our site</div><main><p>{}</p><p>Seen at {}</p></main></body>"
    rows += [(9000 + i, f"http://mirror.example/{i}", mirror.format(story(7), i)) for i in range(3)]
    many = "<body><main><div class=a>Our site</div><p>{}</p></main></body>"
    rows += [(9100 + i, f"http://many.example/{i}", many.format(story(i))) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, name in enumerate(shapes):
        for i in range(4):
            assert got[k * 100 + i] == story(i) + (" The end." if name == "ended" else ""), name
    assert [got[9000 + i] for i in range(3)] == [f"{story(7)} Seen at {i}" for i in range(3)]
    assert [got[9100 + i] for i in range(12)] == [story(i) for i in range(12)]
