import random
import re
from collections import Counter, defaultdict

import pytest

from echoframe.llm import html_template
from echoframe.llm.html_template import LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS, ROOT, Reader, extract_main_text, main_text, templates, token_counts

WORDS = [f"word{i}" for i in range(400)]


def some(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def page(rng, body, i):
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, 4))
    return (
        f"<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f"<header><h1>Site {i}</h1></header><nav><ul>{nav}</ul></nav><!-- ad {i} --><div class='ad'>{some(rng, 6)}</div>"
        f"<div class=\"cookie-notice\">We use cookies {rng.choice(WORDS)}</div>{body}"
        f"<section id='comments'><p>{some(rng, 9)}</p></section><aside><p>{some(rng, 9)}</p></aside>"
        f"<form><label>Search</label><input name=q></form><footer>&copy; host {i} &middot; {rng.choice(WORDS)}</footer></body></html>"
    )


def prose(rng, least=8):
    blocks = [some(rng, rng.randrange(least, 60)) for _ in range(rng.randrange(1, 6))]
    markup = "".join(f"<p>{b.replace(' ', rng.choice([' ', '<b> ', chr(10), ' <i></i>']), 1)}" + rng.choice(["</p>", ""]) for b in blocks)
    return blocks, markup


def texts(spark, pages, hosts=1, parts=3):
    rows = [(i, f"http://h{i % hosts}.example/{i}", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return [r.text for r in sorted(extract_main_text(df).collect())]


def alone(html):
    return main_text(Reader().read(html), [])


def test_article_is_found_whole(spark):
    rng = random.Random(4)
    for n in (1, 3, 24):
        want, pages = [], []
        for i in range(n):
            blocks, markup = prose(rng)
            pages.append(page(rng, f"<article>{markup}<br>a &amp; b&nbsp;&lt;c&gt; end{i}<p>The authors declare no conflict of interest.</article>", i))
            want.append(" ".join(blocks) + f" a & b <c> end{i} The authors declare no conflict of interest.")
        assert texts(spark, pages) == want


def test_pages_without_an_article_element(spark):
    rng = random.Random(5)
    want, pages = [], []
    for i in range(20):
        blocks, markup = prose(rng, 30)
        want.append(" ".join(blocks))
        pages.append(page(rng, f"<div class='content'>{markup}</div>", i))
    assert texts(spark, pages) == want


def plain_page(rng, i, notice):
    """Nothing but ``div``: a long notice that all pages share, and the article."""
    blocks = [some(rng, 12) for _ in range(3)]
    return f"<html><body><div class=a><p>{notice}</p></div><div class=b>{''.join(f'<p>{b}</p>' for b in blocks)}</div><div class=c>{some(rng, 3)}</div></body></html>", " ".join(blocks)


def test_deduction_chooses_the_text(spark, monkeypatch):
    rng = random.Random(6)
    notice = some(rng, 300)
    pages, want = zip(*[plain_page(rng, i, notice) for i in range(12)])
    assert texts(spark, pages) == list(want)
    monkeypatch.setattr(html_template, "LEAST_TOKENS", 10_000)  # no class is valid
    assert all(notice in t for t in texts(spark, pages))


def test_partitions_do_not_matter(spark):
    rng = random.Random(8)
    pages = [page(rng, f"<div class='post-{i} x'>{prose(rng)[1]}</div>" if i % 3 else f"<main>{prose(rng)[1]}</main>", i) for i in range(70)]
    one = texts(spark, pages, 4, 1)
    assert one == texts(spark, pages, 4, 3) == texts(spark, pages, 4, 50) and all(one)


def test_classes_against_their_definition(spark):
    rng = random.Random(7)
    pages = []
    for i in range(60):
        parts = [f"<div class={c}>{'same words' if rng.random() < 0.5 else some(rng, 3)}</div>" for c in "abcde" if rng.random() < 0.8]
        rng.shuffle(parts)
        pages.append((i, f"h{i % 2}", f"<html><body>{''.join(parts)}<ul>{'<section>x</section>' * rng.randrange(3)}</ul></body></html>"))
    df = spark.createDataFrame([(i, h, p, h) for i, h, p in pages], "page_id long, url string, html string, host string").repartition(5)
    got = {}
    for r in templates(token_counts(df)).collect():
        t = html_template.Template.of(r.template)
        got[r.host] = (sorted(sorted(tags) for tags in t.classes.values()), {p: tuple(round(x, 6) for x in e[1]) for p, e in t.elements.items()})
    for host in ("h0", "h1", "*"):
        read = [Reader().read(p) for _, h, p in pages if host in (h, "*")]
        counts = [Counter([(0, t) for t, _, _ in r.tags] + [(1, b.token) for b in r.blocks]) for r in read]
        vector = defaultdict(tuple)
        for t in set().union(*counts):
            vector[t] = tuple(c[t] for c in counts)
        groups = defaultdict(set)
        for t, v in vector.items():
            n = sum(x > 0 for x in v)
            if n >= LEAST_PAGES and n >= LEAST_SHARE * len(read):
                groups[v].add(t)
        valid = [g for g in groups.values() if len(g) >= LEAST_TOKENS]
        assert got[host][0] == sorted(sorted(t for k, t in g if k == 0) for g in valid if any(k == 0 for k, _ in g))
        said = {t for g in valid for k, t in g if k == 1}
        tags = {t for g in valid for k, t in g if k == 0}
        places = {p: x for r in read for p, x in r.places.items()}
        elements = {ROOT} | {p for p, x in places.items() if x.opens in tags or x.closes in tags}
        held, own, on = Counter(), Counter(), Counter(p for r in read for p in r.places)
        for r in read:
            for b in r.blocks:
                if b.token not in said and not r.aside(b.path):
                    around = [p for p in r.places[b.path].around if p in elements]
                    own[around[-1]] += b.plain
                    held.update({p: b.plain for p in around})
        assert got[host][1] == {p: (round(held[p] / on[p], 6), round(own[p] / on[p], 6), 0.0) for p in elements}


def test_copies_of_one_page(spark):
    rng = random.Random(6)
    blocks, markup = prose(rng)
    one = page(rng, f"<article>{markup}</article>", 1)
    assert texts(spark, [one] * 50) == [" ".join(blocks)] * 50


BODY = "<h1>Head line</h1><p>The whole article is here and it is long enough to be most of it.</p>"
TEXT = "Head line The whole article is here and it is long enough to be most of it."
REST = "<nav><a href=/>Home</a></nav>{}<div class='related'><article><p>A card</p></article></div><div id='comments'><p>First</p></div><footer>End</footer>"


@pytest.mark.parametrize(
    "around",
    [
        "<main class='site-main has-sidebar'>{}</main>",
        "<div class='page no-sidebar'><article>{}</article></div>",
        "<article class='post category-legal'>{}</article>",
        "<div class='content related'><article>{}</article></div>",
        "<article><div class='post author'>{}</div></article>",
        "<div class='content legal'><div>{}</div></div>",
        "<div id='page' class='has-sidebar sidebar'>{}</div>",
    ],
)
def test_names_do_not_drop_the_article(around):
    rest = REST if "<article" in around or "<main" in around else REST.replace("article>", "div>")
    assert alone(f"<html><body>{rest.format(around.format(BODY))}</body></html>") == TEXT


LONG = "".join(f"<p>This is sentence number {i} of a text that is long enough.</p>" for i in range(6))
SAID = " ".join(f"This is sentence number {i} of a text that is long enough." for i in range(6))
SIDE = "<aside><p>Somebody else wrote something here once.</p></aside><footer>End of it</footer>"


@pytest.mark.parametrize(
    "html",
    [
        f"<html><body><form id=f action=/><nav><a href=/>Home</a></nav><div>{LONG}</div>{SIDE}</form></body></html>",
        f"<html><body><form><header>Site</header><main>{LONG}</main>{SIDE}</form></body></html>",
        f"<html><body><form><div><article>{LONG}</article></div></form>{SIDE}</body></html>",
        f"<html><head><title>t</title><meta name=x><div>{LONG}</div>{SIDE}</html>",
        f"<head><link rel=x><main>{LONG}</main>{SIDE}",
        f"<title>t</title><p>{SAID}</p>{SIDE}",
        f"<body><nav><a href=/>Home</a><main>{LONG}</main>{SIDE}</body>",
        f"<body><nav><ul><li><a href=/>Home</a></ul><article>{LONG}</article>{SIDE}</body>",
        f"<body><nav><a href=/>Home</a></nav><a name=top><div>{LONG}</div>{SIDE}</body>",
        f"<body><div><p><a href=/>Home</p>{LONG}</div>{SIDE}</body>".replace("Home", ""),
        f"<body><div>{LONG}</div>{SIDE}<form><label>Search for something</label></form></body>",
    ],
)
def test_no_article_is_lost(html):
    assert alone(html) == SAID


def test_pages_without_main_text_stay_empty():
    assert alone(f"<body><nav><a href=/>Home</a></nav><form><label>Search</label></form>{SIDE}</body>") == ""
    assert alone(f"<body><div><p>Text</p></div><aside><article><p>{SAID}</p></article></aside></body>") in ("Text", SAID)


def test_a_form_around_every_page_of_a_host(spark):
    rng = random.Random(12)
    want, pages = [], []
    for i in range(20):
        blocks, markup = prose(rng, 30)
        want.append(" ".join(blocks))
        pages.append(page(rng, f"<div class='content'>{markup}</div>", i).replace("<body>", "<body><form id=all>").replace("</body>", "</form></body>"))
    assert texts(spark, pages) == want


def test_short_article_beside_long_comments():
    comments = f"<div id='comments'><p>{'so much to say ' * 40}</p></div>"
    assert alone(f"<body><div class='sidebar'><article>{BODY}</article></div>{comments}</body>") == TEXT
    assert alone(f"<body><main><article>{BODY}</article>{comments}</main></body>") == TEXT


def test_inside_the_article_all_stays():
    html = "<article><p>Text</p><figure><img><figcaption>A caption</figcaption></figure><math><mi>x</mi></math><object>shown instead</object>"
    html += "<section id=discussion>One</section><div class=legal>Two</div><p class=author>Three</p><div class=content><p>A short intro.</p><p><a>longer link text than that</a></p></div></article>"
    assert alone(html) == "Text A caption x shown instead One Two Three A short intro. longer link text than that"


def test_inline_text_is_joined_as_it_stands():
    assert alone("<p>Hello <b>wor</b>ld, it<i>'</i>s com<!-- x -->mon</p><p>a<br>b</p>") == "Hello world, it's common a b"


def test_table(spark):
    rng = random.Random(7)
    rows = [(i, f"http://h{i % 3}.example/{i}", page(rng, "<article><p>text here</p></article>", i)) for i in range(9)]
    rows += [(None, None, None), (1, "no url", ""), (1, "no url", ""), (2, "http://h0.example", "<p>unclosed <b>a &amp; b <scr"), (3, "http://x/", "plain " * 90000)]
    rows += [(100 + i, "http://fuzz.example/", "".join(rng.choice(["<", ">", "<div", " class='", '"', "a", "&am", "</p>", "<script>", "<!--", "-->", "<article>", "é "]) for _ in range(40))) for i in range(60)]
    df = spark.createDataFrame([(*r, "z", "w") for r in rows], "page_id long, url string, html string, text string, host string").repartition(3)
    got = extract_main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url): r.text for r in got}
    assert by[5, "http://h2.example/5"] == "text here" and by[None, None] == "" and by[1, "no url"] == ""
    assert by[2, "http://h0.example"] == "unclosed a & b" and by[3, "http://x/"] == ("plain " * 90000).strip()
    assert extract_main_text(df.limit(0)).count() == 0


def test_stored_pages(spark, sf):
    """The stored pages have one article element each; its text by regular expressions."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    from html import unescape

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        assert got[r.page_id] == " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner))).split())
