"""WARC archives and main text of pages."""

import hashlib
import random
from collections import Counter

from starloom.llm import html, warc

PAGES = "page_id long, url string, html string"


def resolved(pages, least):
    out = Counter()
    for page_id, _, source in pages:
        data = (source or "").encode()
        same = [p for p, _, s in pages if p is not None and s is not None and s.encode() == data]
        original = max(same, default=None) if len(data) >= least else None
        revisit = page_id is not None and original is not None and original != page_id
        out[page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", original if revisit else None] += 1
    return out


def test_round_trip(make):
    long, nasty = "é" * 700, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "\x00\r\n\r\n\r\n" + "x" * 1500
    pages = [(1, "http://a/", long), (2, None, long), (9, "u\r\nWARC-Type: x", long), (3, "", None), (4, "b", ""), (5, "c", nasty), (6, "c", nasty), (7, "d", "short"), (8, "d", "short"), (None, "e", long)]
    pages += [(9, "again", long), (10, "f", "y" * 300_000), (9, "other payload", nasty), (1, "twice", "z" * 1200), (1, "twice", "z" * 1200)]
    frame = make(pages, PAGES)
    rows = warc.archive_round_trip(frame, 1000).collect()
    assert Counter(map(tuple, rows)) == resolved(pages, 1000)


def test_empty_archive(make):
    assert warc.archive_round_trip(make([], PAGES)).count() == 0


def test_records_have_fresh_headers(spark, make):
    folder = warc.shared_folder(spark, "test")
    warc.write_archives(make([(1, "http://a/", "p" * 2000), (2, "http://b/", "p" * 2000)], PAGES), folder)
    rows = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert rows[1].payload == b"" and rows[1].refers_to == 2 and rows[1].payload_bytes == 2000 and rows[1].url == "http://a/"
    assert rows[2].payload == b"p" * 2000 and rows[2].record_type == "response"


def text(source, templates=frozenset()):
    return html.main_text(html.parse_page(source, templates))


def test_markup():
    assert text(None) == "" and text("") == "" and text("plain &amp; simple\n text") == "plain & simple text"
    assert text("<p>a<p>b <b>c</p>d<br>e<ul><li>f<li>g</ul>") == "a\nb c\nd e\nf\ng"
    assert text("<body><nav>n</nav><header>h</header><article><header><h1>T</h1>by</header><p>x &lt;y&gt;</p></article><footer>f</footer>") == "T\nx <y>"
    assert text("<div class='cookie-notice'>c</div><main>m<form>no</form></main>out") == "m"
    assert text("<article>a<section id=comments><p>c</p></section><div hidden>h</div><div style='display: none'>i</div>b</article>") == "a\nb"
    assert text("a<script>if (x</y) '</div>'</script>b<!-- <p> -->c<style>p{}") == "abc"
    assert text("a < b and c > d <3") == "a < b and c > d <3"
    assert text('<div class="sidebar"><article>teaser</article></div><article>real') == "real"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>&#x41;&nbsp;&eacute;") == "1\n2\n3\nA é"
    assert text("<p " + 'a="' * 50 + "x") is not None


def test_templates_are_deleted(make):
    rows = [(i, "http://h.org/%d" % i, f"<body><div class=x><p>Welcome</p><p>to us</p></div><div><p>Story {i}</p><p>goes on {i * 7}</p></div></body>") for i in range(12)]
    rows += [(100, "http://other.org/", "<body><div class=x><p>Welcome</p><p>to us</p></div></body>"), (101, None, None), (102, "x", ""), (0, "http://h.org/0", rows[0][2])]
    rows += [(200 + i, "http://h.org/copy", "<body><p>A page</p><p>copied often</p></body>") for i in range(30)]
    found = html.extract_main_text(make(rows, PAGES), least_pages=5)
    got = {}
    for r in found.collect():
        got[r.page_id] = r.text
        assert r.n_chars == len(r.text)
    assert all(got[i] == f"Story {i}\ngoes on {i * 7}" for i in range(12))
    assert got[100] == "Welcome\nto us" and got[101] == "" and got[102] == ""
    assert all(got[200 + i] == "A page\ncopied often" for i in range(30))  # copies of one page are no template
    assert found.count() == len(rows)


def test_articles_are_safe_from_templates(make):
    rows = [(i, "http://h.org/", f"<div>menu words</div><article><p>The same licence everywhere</p><p>own {i}</p></article>") for i in range(20)]
    assert {r.text for r in html.extract_main_text(make(rows, PAGES)).collect()} == {f"The same licence everywhere\nown {i}" for i in range(20)}


def test_templates_by_shuffle(make, monkeypatch):
    rows = [(i, "http://h.org/", f"<div>same</div><p>own {i}</p>") for i in range(9)]
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", -1)
    assert {r.text for r in html.extract_main_text(make(rows, PAGES)).collect()} == {f"own {i}" for i in range(9)}
    assert html.extract_main_text(make([], PAGES)).count() == 0


def grown(rng, i, depth=0):
    """A random tree (tag, children) whose leaves are words: few of them, so that subtrees recur, and some of the page's own."""
    tag = rng.choice(["div", "section", "ul", "div", "article", "main"] if depth < 3 else ["p"])
    if tag == "p":
        return tag, [rng.choice(["w1", "w2", "w3", f"own {i} {rng.random()}"])]
    return tag, [grown(rng, i, depth + 1) for _ in range(rng.randrange(1, 4))]


def source_of(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(source_of, tree[1]))}</{tree[0]}>"


def brute_subtrees(tree):
    """All subtrees that are not in, and do not hold, an article or main element."""
    if isinstance(tree, str) or tree[0] in ("article", "main"):
        return set()
    below = set().union(*map(brute_subtrees, tree[1]))
    return below if "<article>" in source_of(tree) or "<main>" in source_of(tree) else below | {source_of(tree)}


def brute_text(tree, templates):
    blocks = []

    def walk(node, article, main):
        if isinstance(node, str):
            blocks.append((node, article, main))
        elif article or main or source_of(node) not in templates:
            for child in node[1]:
                walk(child, article or node[0] == "article", main or node[0] == "main")

    walk(tree, False, False)
    return "\n".join(b[0] for b in ([b for b in blocks if b[1]] or [b for b in blocks if b[2]] or blocks))


def test_what_surrounds_an_article_is_no_template(make):
    page = "<html><body><nav>menu</nav><div>constant</div><div><article><p>own %d</p></article></div><footer>foot</footer></body></html>"
    rows = [(i, "http://h.org/", page % i) for i in range(20)] + [(20 + i, "http://m.org/", page.replace("article", "main") % i) for i in range(20)]
    assert {r.page_id: r.text for r in html.extract_main_text(make(rows, PAGES)).collect()} == {i: f"own {i % 20}" for i in range(40)}


def test_templates_by_brute_force(make):
    rng = random.Random(3)
    trees = [("html", [("body", [("div", ["top"]), *[grown(rng, i) for _ in range(3)], ("div", ["end"])])]) for i in range(120)]
    seen = Counter(s for t in trees for s in brute_subtrees(t))
    templates = {s for s, n in seen.items() if n >= 9}
    assert len(templates) > 5
    rows = [(i, "http://h.org/", source_of(t)) for i, t in enumerate(trees)]
    got = {r.page_id: r.text for r in html.extract_main_text(make(rows, PAGES), least_pages=9).collect()}
    assert got == {i: brute_text(t, templates) for i, t in enumerate(trees)}


def crowd(n, shared):
    """Pages of one host, of which the first ``shared`` have a notice."""
    return [(i, "http://h.org/", f"<div>{'<div>notice here</div>' if i < shared else ''}<p>own {i}</p></div>") for i in range(n)]


def test_templates_do_not_depend_on_the_size_of_the_host(make, monkeypatch):
    for bound in (500_000, -1):
        monkeypatch.setattr(html, "BROADCAST_TEMPLATES", bound)
        for n in (20, 4000):  # 9 pages are less than half a per cent of 4,000
            assert {r.page_id: r.text for r in html.extract_main_text(make(crowd(n, 9), PAGES)).collect()} == {i: f"own {i}" for i in range(n)}
        few = {r.page_id: r.text for r in html.extract_main_text(make(crowd(20, 3), PAGES)).collect()}
        assert few == {i: "notice here\n" * (i < 3) + f"own {i}" for i in range(20)}


def test_rows_of_templates_reach_each_page(make, monkeypatch):
    rows = [(h * 100 + i, f"http://h{h}.org/", f"<div>same {h}</div><div>all</div><p>own {i % 10}</p>") for h in range(3) for i in range(20)]
    rows += [(900, "http://other.org/", "<div>all</div><p>x</p>"), (901, None, None), (902, "http://h0.org/", None)]
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", -1)
    got = sorted((r.page_id, r.text) for r in html.extract_main_text(make(rows, PAGES)).collect())
    assert got == sorted([(h * 100 + i, f"own {i % 10}") for h in range(3) for i in range(20)] + [(900, "all\nx"), (901, ""), (902, "")])


def test_named_wrappers_keep_the_article():
    for name in ("content-sidebar-wrap", "layout no-sidebar", "has-comments", "with-banner", "page-with-sidebar", "sidebar-left", "banner", "comments_wrapper"):
        for key in ("class", "id"):
            for inner in ("<article><h1>T</h1><p>x</p></article>", "<main><h1>T</h1><p>x</p></main>", "<section><article><h1>T</h1><p>x</p></article></section>"):
                assert text(f"<body><nav>n</nav><div {key}='{name}'>{inner}<div class=sidebar>side</div></div><footer>f</footer></body>") == "T\nx"
    assert text("<div class='has-comments'><p>no article</p></div>") == "no article"
    assert text("<div class=banner><div class=popup><main>deep</main></div></div>") == "deep"


def test_other_named_elements_are_dropped():
    assert text("<div class=sidebar><article>a longer teaser</article></div><article>real</article>") == "real"
    assert text("<div>a post in a plain element</div><div class=comments><article>first!</article><article>me too</article></div>") == "a post in a plain element"
    assert text("<div class='banner'><div hidden><main>m</main></div>b</div>out") == "out"
    assert text("<p>a<span class=ad>x</span>b</p><div class='comment-no-5'>c</div><div id='main-nav'>n</div>") == "ab"
    assert text("<article>a<div class='comments wide'><article>reply</article></div>b</article>") == "a\nb"
    assert text("<article><header class=banner><h1>T</h1>by</header>x</article>") == "T\nx"
