from tessera.llm.html_text import extract_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy, now.</div><header>Site</header>
<article><h1>Title &amp; more</h1><p><b>First   line,<br>with a break.<p>Second &lt;b&gt; &amp;amp; line.</p>
<aside>Aside, text.</aside><form><input><p>Form.</p></form><ul><li>One, two.<li>Three.</ul></article>
<div id="comments"><p>A comment, quite long, with points.</p></div><footer>&copy; x</footer></body></html>"""
DENSE = """<body><div class="menu"><a href="#">a</a> <a href="#">b</a></div><div class="text"><p>A long sentence, with commas, and more of them.</p>
<p>Another long sentence, again, with words.</p></div><div><a href="/x">link, link, link.</a></div><div class="cookie-notice">We use cookies, always, everywhere, for all.</div>"""


def test_pages(spark):
    rows = [(1, "http://x.org/a", PAGE, 7), (2, "http://y.org/a", DENSE, 7), (3, None, None, 7), (None, "", "", 7), (5, "http://z.org", "<p>only &nbsp; one, line", 7), (6, "u", "<script>x", 7), (7, "v", "no <", 7)]
    got = {r["id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got[1] == "Title & more\nFirst line, with a break.\nSecond <b> &amp; line.\nOne, two.\nThree."
    assert got[2] == "A long sentence, with commas, and more of them.\nAnother long sentence, again, with words."
    assert got[3] == got[None] == got[6] == ""
    assert got[5] == "only one, line"
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BODY = "<p>The body is long, with commas, and more of them, as texts are.</p><p>It goes on, in a second part, <a href='/x'>with a link</a>, and ends.</p>"
TEXT = "The body is long, with commas, and more of them, as texts are.\nIt goes on, in a second part, with a link, and ends."


def test_names_of_elements_are_evidence_only(spark):
    pages = [
        f"<body><article><p>A teaser, short, with points.</p></article><div class='text'>{BODY}</div><nav><a href='/'>Home</a></nav></body>",
        f"<body class='one-sidebar comments-open'><div class='text'>{BODY}</div><div class='sidebar'><p>Side, text.</p></div></body>",
        f"<body><div class='has-sidebar'>{BODY}</div><footer>Foot, note.</footer></body>",
        f"<body><div class='sidebar-left'><main>{BODY}</main></div><footer>Foot, note.</footer></body>",
        f"<body><div class='modal'>{BODY}</div></body>",
    ]
    got = {r["id"]: r["text"] for r in extract_text(spark.createDataFrame([(k, f"http://h{k}.org/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert got == {0: f"A teaser, short, with points.\n{TEXT}"} | dict.fromkeys(range(1, 5), TEXT)


def test_statistics_of_a_host_choose_within_articles(spark):
    pages = [(k, "http://h.org/", f"<article id='post-{k}'><div><p>{'Words, and more words, in a row. ' * 9}</p></div><ul><li><a href='/{k}'>More</a></li></ul></article>") for k in range(9)]
    got = extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {("Words, and more words, in a row. " * 9).strip()}


def test_many_pages_of_a_host_and_paths_joined(spark, monkeypatch):
    pages = [(k, "http://h.org/", f"<div class='text'><p>Page {k} says this, and that, at some length, with points.</p></div><div class='n{k}'><a href='/'>x{k}</a></div>") for k in range(120)]
    frame = spark.createDataFrame([*pages, (3, "http://h.org/", pages[3][2]), (None, None, pages[5][2])], "page_id long, url string, html string")
    once = sorted((str(r["id"]), r["text"]) for r in extract_text(frame).collect())
    monkeypatch.setattr("tessera.llm.html_text.BROADCAST_KEYS", 0)
    assert sorted((str(r["id"]), r["text"]) for r in extract_text(frame).collect()) == once
    assert all(t == f"Page {5 if k == 'None' else k} says this, and that, at some length, with points." for k, t in once)


def test_a_stray_quote_in_a_tag_loses_no_text(spark):
    page = "<article><p class=\"a>First, with a stray quote.</p><p>Second, after it, \"quoted\" here.</p><p title='x>y'>Third, and last.</p></article>"
    (got,) = extract_text(spark.createDataFrame([(1, "http://h.org", page)], "page_id long, url string, html string")).collect()
    assert "Second, after it" in got["text"] and "Third, and last." in got["text"]


def test_a_very_long_page(spark):
    page = "<article>" + "".join(f"<p>Paragraph {k}, with some words, and a point.</p>" for k in range(20_000)) + "</article><nav>Menu</nav>"
    (got,) = extract_text(spark.createDataFrame([(1, "http://h.org", page)], "page_id long, url string, html string")).collect()
    assert got["text"].count("\n") == 19_999 and "Menu" not in got["text"]


def test_path_statistics_equal_brute_force_and_tell_adverts_without_names(spark, monkeypatch):
    import math

    from tessera.llm import html_text as H

    long = "<p>The body is long, with commas, and more of them, as texts are. It goes on, at some length, for a while.</p>"
    pages = [(k, "http://h.org/", f"<body><ul><li><a href='/'>Home {k}</a></li></ul><div>Buy {k} now, it is new.</div><article><h1>Title {k}</h1>{long * (k + 2)}<ul><li>One, two.</li></ul></article><div>All rights, {k}.</div></body>") for k in range(6)]
    parsed = spark.createDataFrame(pages, "id long, url string, html string").selectExpr("id", "url", "'h' host", "html").mapInArrow(H._parsed, H._NODES)
    got = {r["path"]: r for r in H.path_scores(parsed).collect()}
    sums: dict = {}
    for _, _, page in pages:
        seen = set()
        for path, zone, _, link, text in H.text_nodes(page):
            if text.strip(" "):
                s = sums.setdefault(path, [0, 0, 0, 0, zone])
                s[0] += path not in seen
                seen.add(path)
                s[1] += len(text)
                s[2] += sum(c in ".,;:!?" for c in text)
                s[3] += len(text) if link else 0
    base = lambda path: path.split("#")[0].split("/")
    assert got.keys() == sums.keys()
    for path, (n, chars, points, linked, _) in sums.items():
        around = []
        for k in range(1, min(len(base(path)) - 1, H.STEPS_OUT) + 1):
            inside = [s for p, s in sums.items() if base(p)[:-1] == base(path)[:-k]]
            around.append((H.FURTHER_OUT ** (k - 1) * sum(s[1] / s[0] for s in inside), H.FURTHER_OUT ** (k - 1) * sum(s[2] / s[0] for s in inside)))
        text, point = max(a for a, _ in around), max(b for _, b in around)
        want = math.sqrt(math.sqrt(chars / n * text) * ((points / n + point) / 2 + 0.1)) * (1 - linked / chars)
        assert math.isclose(got[path]["score"], want, rel_tol=1e-9), path
    monkeypatch.setattr(H, "CONTENT_WORTH", 1.0)
    texts = {r["id"]: r["text"] for r in H.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all("Buy" not in t and "rights" not in t and "Home" not in t and t.startswith(f"Title {k}\nThe body") for k, t in texts.items())
