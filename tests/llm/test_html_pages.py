"""Extraction against pages made of marked parts, hostile pages, and words that articles use."""

import random
import time

import pytest

from skyloom.llm.html_extract import extract, extract_pages, markup

#: Parts beside an article, and parts of one, as (html, text); {0} is a sentence.
BESIDE = [
    "<nav><ul><li><a href=/a>Menu {0}</a></li></ul></nav>", "<aside><p>{0}</p></aside>", "<footer><p>{0}</p></footer>",
    '<div class="ad">{0}</div>', '<div class="cookie-banner"><p>{0}</p></div>', '<div id="sidebar-1"><p>{0}</p></div>',
    '<div class="share-buttons"><a href=x>{0}</a></div>', "<form><p>{0}</p><input name=q></form>", "<script>var x = '<p>{0}</p>';</script>",
    "<style>p {{ content: '{0}' }}</style>", "<!-- <p>{0}</p> -->", '<div class="site-notice"><p>{0}</p></div>',
    '<section class="comments"><h2>Replies</h2><p>{0}</p></section>', '<div hidden><p>{0}</p></div>', "<noscript><p>{0}</p></noscript>",
    '<div class="newsletter signup"><p>{0}</p><input type=email></div>', '<ul class="related-links"><li><a href=/b>{0}</a></li></ul>',
]
WITHIN = [
    ("<p>{0}</p>", "{0}"), ("<h2>{0}</h2>", "{0}"), ("<section><h3>{0}</h3><p>{1}</p></section>", "{0}\n{1}"),
    ("<p>{0}<br>{1}", "{0}\n{1}"), ('<p class="market-share">{0}</p>', "{0}"), ("<ul><li>{0}<li>{1}</ul>", "{0}\n{1}"),
    ('<div class="related-work"><h2>{0}</h2><p>{1}</p></div>', "{0}\n{1}"), ('<section class="menu-planning"><p>{0}</p></section>', "{0}"),
    ("<header><h1>{0}</h1></header>", "{0}"), ("<blockquote><p>{0}</p></blockquote>", "{0}"), ("<p>{0} <script>no()</script>{1}</p>", "{0} {1}"),
    ('<p><a href="/x">{0}</a> {1}</p>', "{0} {1}"), ("<p>  {0} \n\t <b>{1}</b></p>", "{0} {1}"), ("<p>{0} &amp; &eacute;&#8211;&lt;b&gt;</p>", "{0} & é–<b>"),
    ("<table><tr><td>{0}</td><td>{1}</td></tr></table>", "{0}\n{1}"), ('<div class="ad">Buy {0}</div>', ""), ("<p>{0}<!-- {1} --></p>", "{0}"),
]


def sentence(rng):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été"]) for _ in range(rng.randrange(6, 15))) + "."


def page(rng, holder):
    inside, lines = ["<h1>The title</h1>"], ["The title"]
    for _ in range(rng.randrange(6, 14)):
        html, text = rng.choice(WITHIN)
        words = sentence(rng), sentence(rng)
        inside.append(html.format(*words))
        lines += [text.format(*words)] if text else []
    around = [rng.choice(BESIDE).format(sentence(rng)) for _ in range(8)]
    close = holder.split()[0]
    return f"<html><body>{''.join(around[:4])}<{holder}>{''.join(inside)}</{close}>{''.join(around[4:])}</body></html>", "\n".join(lines)


@pytest.mark.parametrize("holder", ["article", "main", 'div class="story"'])
def test_marked_articles(spark, holder):
    rng = random.Random(holder)
    made = [page(rng, holder) for _ in range(60)]
    for html, text in made:
        if holder.startswith("div"):
            html, text = html.replace("<header><h1>", "<div><h1>").replace("</h1></header>", "</h1></div>"), text
            for word in ("related-work", "menu-planning", "market-share"):  # outside an article a word counts
                html = html.replace(word, "plain")
        assert extract(html, None) == text
    if not holder.startswith("div"):
        rows = [(i, f"http://h{i % 3}.example/{i}", html) for i, (html, _) in enumerate(made)]
        got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.page_id: r.text for r in got} == {i: text for i, (_, text) in enumerate(made)}


N = 1_000_000
HOSTILE = {
    "tags without end": "<a" * (N // 2),
    "tags without end, then one": "<a" * (N // 2) + ">",
    "a name without end": "<a" + "q" * N,
    "attributes without end": "<a " + "q" * N,
    "declarations": "<!" * (N // 2),
    "open quotes": '<a b="' * (N // 6),
    "open quotes in tags": "<a b=\"' >" * (N // 9),
    "equals signs": "<a " + "a=" * (N // 2) + ">",
    "dashes": "<a " + "-a" * (N // 2) + ">",
    "blanks": "<a x" + " " * N + ">",
    "less than": "<" * N,
    "empty tags": "<>" * (N // 2),
    "comments": "<!--" * (N // 4),
    "scripts": "<script>" * (N // 8),
    "open elements": "<b>" * (N // 3),
    "open elements and blocks": "<b>" * (N // 10) + "<div></div>" * (N // 20) + "</div>" * (N // 50),
    "open elements and items": "<ul>" + "<b>" * (N // 10) + "<li></li>" * (N // 20),
    "a long class": "<p class='" + "ad-" * (N // 3) + "'>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_no_page_takes_long(name):
    """A megabyte each; the quadratic ways would take minutes to hours."""
    began = time.process_time()
    text = extract("<p>kept</p>" + HOSTILE[name], None)
    assert text.startswith("kept") and time.process_time() - began < 10


def test_words_that_articles_use():
    body = "<p>" + "Some words of an article. " * 30 + "</p>"
    long = "Market share grew in this quarter. It fell in the next one. It then grew again by a lot. " * 4
    for name in ("market-share", "related-work", "menu-planning", "widget-theory", "ad-hoc", "header-files"):
        html = f"<body><article>{body}<div class='{name}'><p>{long}</p></div>{body}</article></body>"
        assert long.strip() in extract(html, None), name
    for name in ("share", "related", "notice", "banner", "promo-box"):  # a weak word needs a second sign
        html = f"<body><article>{body}<div class='{name}'>%s</div>{body}</article></body>"
        assert long.strip() in extract(html % f"<p>{long}</p>", None), name
        assert "Short" not in extract(html % "<p>Short.</p>", None), name
        assert "linked" not in extract(html % ("<a href=x>" + "linked text. " * 40 + "</a>"), None), name
    for name in ("sidebar", "ads", "cookie-notice", "comments-area", "newsletter", "site-footer"):
        html = f"<body><article>{body}<div class='{name}'><p>{long}</p></div>{body}</article></body>"
        assert "Market" not in extract(html, None), name


def test_blocks_and_headers():
    assert extract("<p>alpha <script>x</script>beta <style>y</style>gamma</p>", None) == "alpha beta gamma"
    assert extract("<main><header><h1>Title</h1></header><p>Text of it.</p></main>", None) == "Title\nText of it."
    assert extract("<p>one</p><!-- no end <p>two</p>", None) == "one"
    assert extract("<p>one</p><!-- no end", None) == "one"
    assert extract("<p title='a>b' don't>one</p><p>that's</p>", None) == "one\nthat's"


def test_markup_is_whole():
    """Every character is text, a tag, or in what is passed over; text comes back as it was."""
    rng = random.Random(5)
    for _ in range(300):
        source = "".join(rng.choice(["<", ">", "a", " ", "/", '"', "=", "b", "!", "'", "<p>", "</p>", "x"]) for _ in range(rng.randrange(40)))
        parts = list(markup(source))
        rest = source
        for kind, value, _ in parts:
            if kind == "text":
                assert value in rest
                rest = rest[rest.index(value) + len(value) :]
        if "<" not in source or ">" not in source:
            assert "".join(v for k, v, _ in parts if k == "text") == source


def test_any_number_of_templates(spark):
    """Pages of twelve templates of one host, each with a page whose own choice would differ."""
    rows, text = [], "Words of the story, and more of them. " * 6
    for k in range(12):
        name = "abcdefghijkl"[k] * 3
        for i in range(3):
            rows.append((k * 10 + i, "http://h.example/", f"<body><div class={name}><p>{text}{name}</p></div><div class=more{name}><p>x</p></div></body>"))
        rows.append((k * 10 + 9, "http://h.example/", f"<body><div class={name}><p>{name}</p></div><div class=more{name}><p>{text * 2}</p></div></body>"))
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == "abcdefghijkl"[r.page_id // 10] * 3 for r in got if r.page_id % 10 == 9)
