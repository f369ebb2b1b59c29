import html
import math
import re
import statistics
from collections import Counter
from html.parser import HTMLParser

import pytest

from lakeloom.llm import html_text
from lakeloom.llm.html_text import blocks_of, extract, main_text


def article_of(page):
    """What stands between the article's tags, by plain pattern matching."""
    m = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", m[1], flags=re.S))
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
    return " ".join(t for t in texts if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_equal_their_articles(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == article_of(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


PARAGRAPHS = ["First, the long paragraph of the story, with commas, and a full stop.", "Then <i>some</i>thing &amp; more &eacute;t&eacute; &#8212; told\n in   two lines, at length.", "Short one.", "The end, which again is rather long, as such ends are, once they start."]
WANT = "The Title First, the long paragraph of the story, with commas, and a full stop. Then something & more été — told in two lines, at length. Short one. The end, which again is rather long, as such ends are, once they start."
BODY = "<h1>The Title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize("page", [
    f"<html><body><div id=page><div class='main-content'>{BODY}</div><div class='sidebar-left'><p>Side, side, and a long, long text, with commas, to be sure.</p></div></div></body></html>",
    f"<body><header><h1>Site</h1></header><main><nav>a | b</nav><section>{BODY}</section></main><section class=comments><p>A reader says, at great length, that this is not so, or is it, who knows.</p></section><footer>x</footer>",
    f"<div><div><a href=1>one</a> <a href=2>two</a></div><div>{BODY}</div><div><ul><li><a>More</a><li><a>Links</a></ul></div></div>",
    f"<article>{BODY}<div class='ad-box'>Buy, buy, buy.</div><form><p>Your mail, please, here.</p><input></form><script>if (a < b) x = '</p>';</script><style>p > a {{}}</style></article><aside>Other, other.</aside>",
    f"<div id='cookie-notice'><p>We use cookies, yes, we do, and we want you to know, dearly.</p></div><article>{BODY.replace('</p>', '')}</article><div role='complementary'>x, y.</div>",
    f"<TABLE><TR><TD class=menu>a, b<TD>{BODY}</TABLE><!-- <p>hidden, hidden</p> --><noscript><p>No, script.</p></noscript>",
    f"<article>{BODY}<!-- never ended",
])
def test_layouts(page):
    assert main_text(page) == WANT


def test_odd_markup():
    assert main_text(None) == main_text("") == main_text("<html><head><title>t</title></head><body></body></html>") == ""
    assert main_text("plain text &lt;b&gt; only") == "plain text <b> only"
    assert main_text("a < b and <b>c</b>d<br>e") == "a < b and cd e"
    assert [b.text for b in blocks_of("<ul><li>a<li>b</ul>c<p>d<div>e</div>")] == ["a", "b", "c", "d", "e"]
    assert main_text("<p title='a > b'>x</p></i></div>") == "x"
    assert len(main_text("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4


def test_edges(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (1, "u", "<p>b</p>", None), (1, "u", "<p>b</p>", None), (2, "v", "<p>" + "long, text. " * 50_000, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    assert sorted(((r["page_id"] or 0), r["text"][:5], r["n_chars"]) for r in extract(pages).collect()) == [(0, "a", 1), (1, "", 0), (1, "b", 1), (1, "b", 1), (2, "long,", 599_999)]
    assert extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["div", "section", "center"])
@pytest.mark.parametrize("cut", [1, 2, 3])
def test_articles_split_over_sections_of_unequal_length_are_whole(tag, cut):
    first, second = ("".join(f"<p>{p}</p>" for p in part) for part in (PARAGRAPHS[:cut], PARAGRAPHS[cut:]))
    long = "<p>" + "A much longer paragraph, with commas, that goes on, and on, to the end. " * 8 + "</p>"
    for one, two in ((long + first, second), (first, second + long)):
        whole = " ".join(re.sub("<[^>]+>", " ", html.unescape(re.sub("</?i>", "", one + two))).split())
        page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><div id=main><h1>The Title</h1><{tag}>{one}</{tag}><{tag}>{two}</{tag}></div></body>"
        assert main_text(page).removeprefix("one two ") == "The Title " + whole
        assert main_text(f"<table><tr><td>{one}<td>{two}</table>") == whole


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "page with-header", "layout-sidebar-right", "page-with-header", "sidebar-layout menu", "site_without_footer"])
def test_wrappers_that_tell_the_layout_are_kept(name):
    beside = "<div class='sidebar left'><p>Side, side, and a text, with commas.</p></div><div class='comments'><article><p>A reader, too, says something here.</p></article></div>"
    assert main_text(f"<body><div class='{name}'><article>{BODY}</article></div></body>") == WANT
    assert main_text(f"<body><div class='{name}'><div>{BODY}</div></div><footer>x</footer></body>") == WANT
    assert main_text(f"<body><div class='{name}'><article>{BODY}</article><div class='sidebar left'><p>Side, side, and a text, with commas.</p></div></div></body>") == WANT
    assert main_text(f"<body><div class='{name}'><article>{BODY}</article>{beside}</div></body>") == WANT
    assert main_text(f"<body><div class=header><h1>Site</h1></div><div class='{name}'><article>{BODY}</article></div><div>Copyright.</div></body>") == WANT


def test_marks_never_drop_everything_but_long_comments():
    assert main_text(f"<div class=widget>{''.join(f'<p>{p}</p>' for p in PARAGRAPHS)}</div>") == WANT.removeprefix("The Title ")
    assert main_text(f"<article>{BODY}</article><div class=comments>" + "<article><p>A reader, too, says something here, at length.</p></article>" * 30 + "</div>") == WANT


class PlainRatios(HTMLParser):
    """Tag-path ratios by the standard library's parser; of names it knows adverts alone: blocks, their paths and innermost elements."""

    def __init__(self, page):
        super().__init__()
        self.open, self.blocks, self.n, self.text = [("", 0)], [], 0, ""
        self.feed(page)
        self.flush()

    def flush(self):
        text, self.text = " ".join(self.text.split()), ""
        if text and not {"head", "script", "style"} & {t for t, _ in self.open}:
            self.blocks.append((tuple(self.open), text, "a" in self.inside))
        self.inside = set()

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "i", "a", "br"):
            self.text += " " * (tag == "br")
            self.inside |= {tag}
            return
        self.flush()
        if tag == "p" and self.open[-1][0] == "p":
            self.open.pop()
        if tag not in ("meta", "link"):
            self.n += 1
            self.open.append(("script" if ("class", "ad") in attrs else tag, self.n))

    inside: set = set()

    def handle_endtag(self, tag):
        tag = "script" if self.open[-1][0] == "script" else tag
        if tag in [t for t, _ in self.open]:
            self.flush()
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.text += data

    def content(self):
        paths = [tuple(t for t, _ in own) for own, _, _ in self.blocks]
        ratio = {p: (statistics.mean(len(x[1]) for x, q in zip(self.blocks, paths) if p == q), statistics.mean(len(re.findall(r"[.,;:!?…]", x[1])) for x, q in zip(self.blocks, paths) if p == q)) for p in set(paths)}
        places = [next((e for e in reversed(own) if e[0] in ("html", "body", "article", "div", "nav", "footer")), 0) for own, _, _ in self.blocks]
        scores = []
        for i, (own, _, linked) in enumerate(self.blocks):
            near = [k for k in range(i - 2, i + 3) if 0 <= k < len(paths) and places[k] == places[i]]
            w = [math.exp(-((k - i) ** 2) / 2) for k in near]
            length, points = (sum(x * ratio[paths[k]][c] for x, k in zip(w, near)) / sum(w) for c in (0, 1))
            scores.append(math.sqrt(length * (points + 1 / (1 + length))) * 0.1 ** (linked + any(t in ("nav", "footer") for t, _ in own)))
        least = statistics.pstdev(scores) / 2
        good = {p for p in set(paths) if statistics.mean(s for s, q in zip(scores, paths) if p == q) >= least and not {"nav", "footer"} & set(p)}
        total = sum(len(x[1]) for x, p in zip(self.blocks, paths) if p in good)
        held = Counter()
        for (own, text, _), p in zip(self.blocks, paths):
            for e in own:
                held[e] += len(text) * (p in good)
        where = max((e for e in held if held[e] >= 0.7 * total), key=lambda e: (e[0] == "article", -e[1]))
        return " ".join(text for own, text, _ in self.blocks if where in own)


def test_plain_ratios_agree_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert [r["page_id"] for r in pages if PlainRatios(r["html"]).content() != main_text(r["html"])] == []


def test_ratios_decide_where_no_name_tells(monkeypatch):
    links = "".join(f"<li>{w}" for w in ("News", "Sport", "World", "Money", "Travel"))
    pages = [f"<body><div class=a1><ul>{links}</ul></div><div class=a2>{BODY}</div><div class=a3><ul>{links}</ul></div></body>", f"<table><tr><td><ul>{links}</ul><td>{BODY}<td><ul>{links}</ul></table>"]
    assert [main_text(p) for p in pages] == [WANT, WANT]
    monkeypatch.setattr(html_text, "block_scores", lambda blocks: [1.0] * len(blocks))
    assert all(main_text(p) != WANT and "Travel" in main_text(p) for p in pages)


def test_sections_that_belong_to_the_article():
    title, figure = "<div><h1>The Title</h1></div>", "<div>A figure</div>"
    first, second = ("".join(f"<p>{p}</p>" for p in part) for part in (PARAGRAPHS[:2], PARAGRAPHS[2:]))
    page = f"<div id=x><div><a href=1>one</a> <a href=2>two</a></div>{title}<div>{first}</div>{figure}<div><a href=3>three</a></div><div>{second}</div><div>End</div></div>"
    assert main_text(page) == WANT.replace("Short one.", "A figure Short one.")
    assert main_text(f"<body><article>{BODY}<nav><p>On, and on.</p></nav><footer>Tags</footer></article></body>") == WANT
    assert main_text("<nav><a href=1>one</a></nav><footer>All, that is here.</footer>") != ""


PROSE = "A reader of this, in turn, may want to know more, and so it goes on, at length, to the end."


@pytest.mark.parametrize("part", [
    f"<p class='search-result'>{PROSE}</p>", f"<p class='related-work'>{PROSE}</p>", f"<p class='notice'>{PROSE}</p>", f"<section class='discussion'><p>{PROSE}</p></section>", f"<div class='share'><p>{PROSE}</p></div>", f"<div class='toc'><p>{PROSE}</p></div>", f"<div class='register'><p>{PROSE}</p></div>",
])
def test_prose_in_an_article_stays_whatever_its_name(part):
    for tag in ("article", "main"):
        assert main_text(f"<body><{tag}>{BODY}{part}</{tag}><footer>x</footer></body>") == f"{WANT} {PROSE}"
    # Outside of it the same name marks it as something else.
    assert main_text(f"<body><article>{BODY}</article>{part}</body>") == WANT


def test_doubtful_parts_and_lists_of_links_in_an_article_go_by_their_score():
    share, more = "<div class='share'><span>Share</span> <span>Tweet</span></div>", "<ul><li><a href=1>More of it</a><li><a href=2>And this</a></ul>"
    assert main_text(f"<article>{BODY}{share}{more}</article>") == WANT
    listed = "<ul><li>Flour<li>Two eggs<li>Sugar</ul>"
    assert main_text(f"<article>{BODY}{listed}</article>") == f"{WANT} Flour Two eggs Sugar"


def test_the_only_title_before_the_content_stays():
    page = "<body><h1>The Title</h1><div><a href=1>one</a> <a href=2>two</a></div><div class=post>" + BODY.replace("<h1>The Title</h1>", "") + "</div></body>"
    assert main_text(page) == WANT
    assert main_text(f"<body><h1>Site</h1><div class=post>{BODY}</div></body>") == WANT


@pytest.mark.parametrize("heading", ["3 responses", "Comments", "Comments (12)", "Leave a reply", "2 Kommentare", "Comentarios"])
def test_comments_under_a_heading_that_tells_them_go(heading):
    comments = f"<h3>{heading}</h3><p>{PROSE}</p><p>{PROSE}</p>"
    for page in (f"<body><div class=c1>{BODY}</div><div class=c2>{comments}</div></body>", f"<body><article>{BODY}</article><div class=c2>{comments}</div></body>", f"<article>{BODY}{comments}</article>"):
        assert main_text(page) == WANT


def without_names(page):
    """The page's article and boilerplate in plain divisions, without classes."""
    return re.sub(r"(</?)(?:article|nav|footer)\b", r"\1div", re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page))


def test_ratios_decide_without_names(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    links = "".join(f"<li><a href=1>{w}</a>" for w in ("News", "Sport", "World", "Money", "Travel"))
    small = [f"<div><div><ul>{links * n}</ul></div><div>{BODY}</div><div>Imprint</div></div>" for n in range(1, 5)] + [f"<article>{BODY}<ul>{links}</ul></article>", f"<main>{BODY}<div class=share>Share</div></main>"]
    right = lambda: (sum(main_text(without_names(h)) == article_of(h) for h in pages), sum(main_text(h) == WANT for h in small))
    by_ratio, small_by_ratio = right()
    texts = [main_text(without_names(h)) for h in pages]
    monkeypatch.setattr(html_text, "block_scores", lambda blocks: [1.0] * len(blocks))
    constant, small_constant = right()
    changed = sum(a != main_text(without_names(h)) for a, h in zip(texts, pages))
    assert changed > 0.1 * len(pages) and by_ratio > constant
    assert small_by_ratio == len(small) and small_constant <= 0.9 * len(small)
