"""Main text of pages whose text is known."""

import random

from ledgerlake.llm import html_main as H


def page(i, body, host="h.example"):
    nav = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News"))
    return (i, f"https://{host}/p/{i}?q", f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>T</title><style>p{{}}</style>
<script>var t="</p><article>";</script></head><body><nav><ul>{nav}</ul></nav><!-- ad {i} --><div class="ad">Buy {i}</div>
{body}<footer>&copy; site &middot; x</footer></body></html>""", 1)


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    return {r.page_id: r.text for r in H.extract_main_text(df).collect()}


def test_articles(spark):
    shared = "<p>A passage that all pages share.</p>"
    rows = [page(i, f"<article><h1>Title {i} &amp; more</h1><p><b>Lead {i}<br><p>one\n  two&nbsp;{i}</p>{shared}"
                    f"<div class='box'>Follow us</div><ul><li>a<li>b {i}</ul></article>") for i in range(12)]
    rows.append(page(50, "<article><h1>x</h1><p>cut off &lt;here"))
    rows[-1] = (50, rows[-1][1], rows[-1][2].split("&lt;here")[0] + "<p cla", 1)
    got = run(spark, rows)
    for i in range(12):
        assert got[i] == f"Title {i} & more\n\nLead {i}\n\none two {i}\n\nA passage that all pages share.\n\na\n\nb {i}"
    assert got[50] == "x\n\ncut off"


def test_template_without_semantic_tags(spark):
    rows = [page(i, f"<div><div>Top stories</div><div><p>Story number {i}.</p><p>More on {i}</p></div><div>Follow the site</div></div>", "t.example")
            for i in range(10)]
    rows += [(100 + i, *rows[3][1:]) for i in range(3)]  # copies make no template
    got = run(spark, rows)
    assert all(got[i] == f"Story number {i}.\n\nMore on {i}" for i in range(10)) and got[101] == got[3]


def test_kinds_that_are_never_main_text(spark):
    body = ("<header>Site</header><main><article><header><h1>Head</h1></header><p>Text<script>x<y</script> goes on</p>"
            "<aside>See also</aside><form><input><label>Mail</label></form><div id='cookie-notice'>OK?</div>"
            "<p hidden>no</p><table><tr><td>a</td><td>b</td></tr></table><section class='comments'><article class='comment'>first!</article></section>"
            "</article></main><div class=sidebar>Side</div>")
    assert run(spark, [page(1, body)]) == {1: "Head\n\nText goes on\n\na b"}


def test_edges(spark):
    rows = [(1, None, None, 1), (2, "http://a/", "", 1), (3, "http://a/", "plain  text &eacute; < 5", 1), (4, "x", "<p>one<p>two<div>three", 1),
            (4, "x", "<p>one<p>two<div>three", 1), (None, "y", "<article>n", 1), (6, "http://a/", "<div>" * 3000 + "deep", 1),
            (7, "http://a/", '<p title="a>b" class=\'q"\'>quoted</p', 1), (8, "http://a/", "<article><p>w</p></article>" + "<p>" + "v " * 100000, 1)]
    got = run(spark, rows)
    assert got == {1: "", 2: "", 3: "plain text é < 5", 4: "one\n\ntwo\n\nthree", None: "n", 6: "deep", 7: "quoted", 8: "w"}
    assert run(spark, [page(1, "")][:0]) == {}


def test_time_grows_with_the_length():
    import time
    for html in ("<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 100_000, "<header>" * 30_000 + "<h1>x",
                 "<main>" * 30_000 + "<article>x", "<a \"" * 50_000 + "x", "<p><b>" * 50_000 + "x", "<" * 100_000, "<!" * 50_000):
        began = time.perf_counter()
        H.main_text(H._parsed(html), frozenset())
        assert time.perf_counter() - began < 5, html[:20]


def site(pages, seed):
    """Pages of nested div elements without any telling tag or name: a shared frame around own paragraphs, and the texts."""
    rnd = random.Random(seed)
    words = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(5000)) for _ in range(n))
    top = f"<div><div>{words(3)}</div><div><ul><li>{words(1)}<li>{words(2)}</ul></div></div>"
    side, bottom = f"<div><p>{words(5)}</p><div>{words(9)}</div></div>", f"<div>{words(8)}<br>{words(2)}</div>"
    rows, texts = [], {}
    for i in range(pages):
        own = [words(rnd.randrange(4, 30)) for _ in range(rnd.randrange(1, 6))]
        rare = f"<div>{words(4)}</div>" if rnd.random() < .5 else ""
        body = "".join(f"<p>{p}</p>" for p in own)
        rows.append((i, f"http://s{seed}.example/{i}", f"<html><body>{top}<div>{rare}<div>{body}</div>{side}</div>{bottom}</body></html>", 1))
        texts[i] = "\n\n".join([*([rare[5:-6]] if rare else []), *own])
    return rows, texts


def test_template_removal_finds_what_pages_share(spark, monkeypatch):
    """Brute force: without article tags and names, main text is what a page does not share with its site."""
    rows, texts = site(25, 4)
    assert run(spark, rows) == texts
    monkeypatch.setattr(H, "MIN_SHARE", 2.0)
    monkeypatch.setattr(H, "ARTICLE_SHARE", 2.0)
    without = run(spark, rows)
    assert all(without[i] != texts[i] for i in texts)
