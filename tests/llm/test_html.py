"""Main text: pages made around known articles, odd markup, odd rows."""

import random
from html import escape

import pytest

from apptflow.llm import html as H

NOISE = ['<nav><ul><li><a href="/a">Home, sweet, home</a></li><li><a href="/b">News</a></li></ul></nav>',
         '<header><h1>Site name</h1><p>A slogan, with commas, to tempt, the scorer, of pages.</p></header>',
         '<aside><p>Sidebar, text, with, commas, and quite a lot of length to it, so that it would score.</p></aside>',
         '<div class="ad">Buy this, buy that, buy now.</div>', '<div id="cookie-notice"><p>We use cookies, sadly.</p></div>',
         '<form><p>Name, please</p><input name="q"><button>Go</button></form>', '<script>var t="</p>, <p>x,y,z</p>";</script>',
         '<style>p{margin:0}</style>', '<!-- a comment, <p>with a paragraph</p> -->',
         '<div class="commentList"><p>First, nice, post, thank you, very much, indeed, for this.</p></div>',
         '<footer>&copy; example.com, all rights, reserved, by, us, and, others.</footer>',
         '<section class="related-posts"><a href="/x">Read, this, too, and, that</a></section>']


def page(rng, blocks, wrap):
    body = "".join(f"<p>{escape(b)}</p>" for b in blocks)
    noise = lambda: "".join(rng.sample(NOISE, rng.randint(0, 5)))
    return f"<!DOCTYPE html><html><head><title>T, t</title></head><body>{noise()}<{wrap}>{noise()}{body}</{wrap}>{noise()}</body></html>"


@pytest.mark.parametrize("wrap", ["article", "div", "main", "section"])
def test_articles_among_noise(spark, wrap):
    rng = random.Random(wrap)
    words = ["alpha", "beta,", "gamma", "délta", "<tag>", "a&b", "x;", "日本"]
    rows, want = [], {}
    for i in range(60):
        blocks = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8))]
        rows.append((i, page(rng, blocks, wrap), "u", "t"))
        want[i] = "\n\n".join(blocks)
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    assert {r.page_id: r.text for r in H.extract_text(df).collect()} == want


def test_markup():
    t = lambda h: "\n\n".join(H.main_blocks(h))
    assert t("<article><h1>Title</h1><p><b>One<br><p>Two &amp;&#33; &copy</article>") == "Title\n\nOne\n\nTwo &! ©"
    assert t("<article><p>a\n\t b&nbsp;  c</p><ul><li>x<li>y</ul><pre>p\n q</pre></article>") == "a b c\n\nx\n\ny\n\np q"
    assert t("<p>1 < 2 and 3 > 2<p a='>' b=\">\">second") == "1 < 2 and 3 > 2\n\nsecond"
    assert t("<article><p>in<script>if (a</b) { '</p>' }</script>side</p></article>") == "inside"
    assert t("<article><p>cut off <a href='x") == t("<article><p>cut off </p") == "cut off"
    assert t("<article><p>one <a href=\"x>two</a> three") == "one two three"
    assert t("<article><p>never closed <!-- comment") == "never closed"
    assert t("plain text only") == "plain text only"
    assert t("</div></p>stray") == "stray" and t("<div/>x") == "x"
    assert t("") == t("   ") == t("<script>x") == t("<nav>menu</nav>") == ""


def test_siblings_that_read_like_prose_are_kept():
    long = "This sentence, which is long, has commas, and it goes on, so that it is prose, as prose is, and no menu at all."
    got = H.main_blocks(f"<body><div><p>{long}</p><p>{long}</p></div><p>{long}</p><p><a href='/'>{long}</a></p></body>")
    assert got.count(long) >= 3


def test_deep_and_long_pages():
    assert H.main_blocks("<div>" * 5000 + "<p>deep, text</p>") == ["deep, text"]
    long = "<article>" + "<p>some, words here</p>" * 20_000 + "</article>"
    assert len(H.main_blocks(long)) == 20_000
    H.main_blocks("<a \"" * 3000)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "<p>x</p>"), (1, ""), (2, "<p>x</p>"), (2, "<p>x</p>")], "page_id long, html string")
    assert sorted((str(r.page_id), r.text) for r in H.extract_text(df).collect()) == [
        ("1", ""), ("1", ""), ("2", "x"), ("2", "x"), ("None", "x")]
    assert H.extract_text(df.limit(0)).count() == 0


LONG = "A paragraph, of some length, that goes on and on so that it scores as the prose of an article does. " * 2


def test_parts_of_an_article_of_any_length_are_kept():
    many, end = f"<p>{LONG}</p>" * 8, "x" * 190 + ", with, commas"
    want = ["T", *[LONG.strip()] * 8, "End", end, "one", "bare"]
    rest = f"<h2>End</h2><section><p>{end}</p></section><ul><li>one</li></ul>bare"
    for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<body>", "</body>"), ("", "")):
        assert H.main_blocks(f"{a}<h1>T</h1><section>{many}</section>{rest}{b}") == want, a
    links = "<div><a href='/'>Here, there</a> <a href='/'>and there</a></div>"
    got = H.main_blocks(f"<div><h1>T</h1><section>{many}</section>{rest}</div>{links}")
    assert got == want
    got = H.main_blocks(f"<article><div><section>{many}</section></div><figure><figcaption>Seen</figcaption></figure></article>{links}")
    assert got == [LONG.strip()] * 8 + ["Seen"]
    got = H.main_blocks(f"<body><a href='#c'>Skip to it</a><div><section>{many}</section>Read <a href='/'>this</a></div></body>")
    assert got == [LONG.strip()] * 8 + ["Read this"]


def test_marks_do_not_empty_a_page():
    body = f"<h1>T</h1><p>{LONG}</p><div class='share'>Share</div>"
    want = ["T", LONG.strip()]
    for tag in ('article class="post category-legal"', 'main id="search-results-article"', 'div class="legal"',
                'div class="search"><div id="notice"'):
        name = tag.split()[0]
        assert H.main_blocks(f"<body><{tag}>{body}</{name}></body>") == want, tag
    comment = '<article class="comment"><p>Nice, long, post, I, say, with, many, commas, in, it, all.</p></article>'
    assert H.main_blocks(f"<article>{body}{comment}</article>") == want
    assert H.main_blocks(f"<p>Short.</p><div class='comments'>{body}</div>") == ["Short."]


LONG = "This paragraph is long enough to be read, with commas, clauses, and a plain end. " * 4


@pytest.mark.parametrize("part", ['<section id="discussion">{}</section>', '<section class="related-work">{}</section>',
                                  '<div class="legal-background">{}</div>', '<blockquote class="notice">{}</blockquote>',
                                  '<div class="search-methods"><div>{}</div></div>'])
def test_words_of_a_subject_keep_prose_inside_the_article(part):
    p = f"<p>{LONG}</p>"
    text = LONG.strip()
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1>{p}{part.format(p)}{p}</article></body>"
    assert H.main_blocks(page) == ["T", text, text, text]
    # links and short notices of the same words go
    links = "<p>" + "".join(f'<a href="{i}">Another page, and one more</a> ' for i in range(12)) + "</p>"
    for junk in (links, "<p>Accept, or leave.</p>"):
        assert H.main_blocks(f"<body><article><h1>T</h1>{p}{part.format(junk)}{p}</article></body>") == ["T", text, text]
    # outside an article they mark as before
    assert H.main_blocks(f"<body><article>{p}{p}</article>{part.format(p)}</body>") == [text, text]


def test_comment_and_advert_articles_go_where_another_has_text():
    p, c = f"<p>{LONG}</p>", f"<p>Reader: {LONG}</p>"
    text = LONG.strip()
    for kind in ("comment", "user-comments", "ad-card", "sponsored"):
        assert H.main_blocks(f'<main><article>{p}{p}</article><article class="{kind}">{c}</article></main>') == [text, text]
        assert H.main_blocks(f'<main>{p}{p}<article class="{kind}">{c}</article></main>') == [text, text]
        # a theme's class on the only article marks nothing
        assert H.main_blocks(f'<body><article class="post {kind}">{p}{p}</article></body>') == [text, text]


def test_headings_of_an_articles_header_stay():
    p = f"<p>{LONG}</p>"
    page = f"""<body><header><h1>Site</h1></header><article><header class="entry-header"><div><h1>Title</h1></div><p>By A. Writer, today</p>
    <nav><h2>Menu</h2></nav><h2>Second line</h2></header>{p}<footer><h3>More</h3></footer></article></body>"""
    assert H.main_blocks(page) == ["Title", "Second line", LONG.strip()]


def test_generated_pages_by_construction():
    """Pages put together from known article and other parts, nested at random: the
    text is the article's parts, in order."""
    rnd = random.Random(11)

    def words(n):
        return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta,", "epsilon", "zeta", "&amp;", "eta"]) for _ in range(n))

    for _ in range(150):
        want = []

        def prose(n):
            t = words(n) + "."
            want.append(" ".join(t.replace("&amp;", "&").split()))
            return t

        def section(depth):
            kinds = rnd.choices(["p", "h", "ul", "div", "quote", "junk", "weak"], k=rnd.randint(1, 4))
            out = ""
            for k in kinds:
                if k == "p":
                    out += f"<p>{prose(rnd.randint(40, 90))}</p>"
                elif k == "h":
                    out += f"<h2>{prose(3)}</h2>"
                elif k == "ul":
                    out += f"<ul><li>{prose(8)}</li>\n<li>{prose(9)}</li></ul>"
                elif k == "quote":
                    out += f"<blockquote>{prose(30)}</blockquote>"
                elif k == "weak":
                    out += f'<div class="{rnd.choice(["related-work", "legal", "discussion"])}"><p>{prose(80)}</p></div>'
                elif k == "junk":
                    out += rnd.choice([f'<div class="newsletter"><p>{words(60)}</p></div>', f"<aside>{words(40)}</aside>",
                                       f'<div class="share"><a href=a>{words(3)}</a></div>', f"<form>{words(9)}</form>",
                                       f'<section class="comments"><p>{words(70)}</p></section>', f"<script>{words(5)}</script>"])
                elif depth:
                    out += f"<section>{section(depth - 1)}</section>"
            return out
        body = f"<h1>{prose(4)}</h1><p>{prose(90)}</p>{section(2)}<p>{prose(90)}</p>"
        page = (f"<html><body><header>{words(5)}</header><nav><ul><li><a href=a>{words(2)}</a></ul></nav><div class=wrap><main><article>{body}"
                f'</article><article class="comment"><p>{words(50)}</p></article></main><div class="sidebar"><p>{words(80)}</p></div></div>'
                f"<footer>{words(8)}</footer></body></html>")
        assert H.main_blocks(page) == want
