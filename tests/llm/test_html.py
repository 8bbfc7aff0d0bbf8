"""Main text of pages: written cases, and the test pages against their markup."""

import html
import re
import time

import pytest

from popweave.llm import html_text
from tests.conftest import SF_MID

STORY = "The council met on Tuesday to hear what the engineers had to say about the bridge and its old arches. " * 2
CASES = [
    (None, ""), ("", ""), ("<html></html>", ""), ("no markup at all", "no markup at all"),
    (f"<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>{STORY}<p>End &lt;here&gt;</article><footer>&copy; x</footer>",
     f"A & B {STORY.strip()} End <here>"),
    (f"<article><p>One<br>two <b>th</b>ree\n\t four</p><script>var a='<p>no</p>';</script><!-- <p>no</p> --><p>{STORY}</p></article>",
     f"One two three four {STORY.strip()}"),
    (f"<header><h1>Site</h1></header><main><p>{STORY}</p><aside>See also this</aside><form><p>Your mail</p></form>"
     f"<section class='comments'><p>{STORY}</p></section></main>", STORY.strip()),
    (f"<div class='ad'>Buy now.</div><div class=content><p>{STORY}</p><p>Yes.</p></div><div class='cookie-notice'><p>{STORY}</p></div>",
     f"{STORY.strip()} Yes."),
    (f"<article><p>{STORY}</p><p>cut off he", f"{STORY.strip()} cut off he"),
    (f"<article><p>{STORY}</p></article><script>never closed <p>{STORY}</p>", STORY.strip()),
    (f"<head><title>T</title><style>p{{}}</style></head><body><article><p>{STORY}</p><p>a &lt b</p></article>", f"{STORY.strip()} a < b"),
    ("<article><p>" + "word " * 200_000 + "</p></article>", ("word " * 200_000).strip()),
    # Names that begin like a silent element's, and self-closed ones.
    *[(f"<{e}>{i}</{e}><article><p>{STORY}</p></article>", STORY.strip()) for e in ("svg-icon", "video-js", "button-group", "title-bar")
      for i in ("", " ")],
    *[(f"<article><p>{STORY}<{e}/></p><p>{STORY}</p></article>", f"{STORY.strip()} {STORY.strip()}") for e in ("svg width='1'", "math ")],
    (f"<article><p>{STORY}</p><svg><style/><title/><path d='M0'/><text>no</text></svg><p>Yes.</p></article>", f"{STORY.strip()} Yes."),
    # Unclosed silent elements end with their container.
    *[(f"<article><div><{e}>no</div><p>{STORY}</p><p>Yes.</p></article>", f"{STORY.strip()} Yes.")
      for e in ("button", "option", "title", "object", "canvas", "video", "iframe", "select", "noscript", "svg", "audio src='a>b'")],
    *[(f"<article><p>{STORY}<{e}>no{p}<p>Yes.</p></article>", f"{STORY.strip()} Yes.") for e in ("button", "video") for p in ("</p>", "")],
    (f"<article><ul><li>One.<button>no<li>Two.</ul><p>{STORY}</p></article>", f"One. Two. {STORY.strip()}"),
    (f"<article><p>{STORY}<span><canvas>no</span> Yes.</p></article>", f"{STORY.strip()} Yes."),
    (f"<article><p>{STORY}<button><div>no</div></button> Yes.</p><select><option>no<option>no</select></article>", f"{STORY.strip()} Yes."),
    (f"<article><p>{STORY}</p><textarea>never closed <p>{STORY}</p></article>", STORY.strip()),
    # Heads whose end tag, or whose body's start tag, is left out.
    (f"<html><head><title>T</title><meta charset=utf-8><article><p>{STORY}</p></article>", STORY.strip()),
    (f"<head><title>T</title><noscript><img src=a>no</noscript><style>p{{}}</style><p>{STORY}</p>", STORY.strip()),
    (f"<head><title>T<article><p>{STORY}</p><svg><title>no</title></svg></article>", STORY.strip()),
    (f"<head><title>A <script> in a title</title></head><article><p>{STORY}</p></article>", STORY.strip()),
    (f"<head-line>x</head-line><article><p>{STORY}</p></article>", STORY.strip()),
    # Formulas are text of their block; annotations repeat them.
    (f"<article><p>{STORY} Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><p>Yes.</p></article>", f"{STORY.strip()} Let x=2 be. Yes."),
    (f"<article><p>{STORY} So <math><semantics><mi>y</mi><annotation encoding='application/x-tex'>no</annotation><annotation-xml><mi>no</mi>"
     f"</annotation-xml></semantics></math>.</p><annotation>Yes.</annotation></article>", f"{STORY.strip()} So y. Yes."),
    (f"<article><p>{STORY} So <math><mi>y</mi><annotation/><annotation>no</math>.</p></article>", f"{STORY.strip()} So y."),
]


S = STORY.strip()
CASES += [
    # Readers' texts are articles of their own on many pages.
    *[(f"<article><h1>Title</h1><p>{STORY}</p></article><{e} id='comments'><h2>Comments</h2><ol><li><article class='comment-body'><p>{STORY}"
       f"</p></article></li><li><article><p>Me too.</p></article></li></ol></{e}>", f"Title {S}") for e in ("div", "section")],
    (f"<main><article><p>{STORY}</p><div class='comment-list'><article class='comment'><p>{STORY}</p></article></div></article></main>", S),
    # An article's own parts may be called what boilerplate is called elsewhere.
    (f"<article><p>{STORY}</p><section id='discussion'><h2>Discussion</h2><p>{STORY}</p></section></article>", f"{S} Discussion {S}"),
    (f"<article><p class='teaser'>In short, it closed.</p><p>{STORY}</p></article>", f"In short, it closed. {S}"),
    *[(f"<article><div class='{c}'><h1>Title</h1></div><p>{STORY}</p></article>", f"Title {S}") for c in (
        "entry-header", "article-header", "post header", "header", "EntryHeader")],
    (f"<article><section class='search-results-discussion'><p>{STORY}</p></section></article>", S),
    *[(f"<div class='{c}'><article><p>{STORY}</p><p>Yes.</p></article></div>", f"{S} Yes.") for c in (
        "content-with-sidebar", "no-comments", "comments-open", "has-widgets", "two-column")],
    # Boilerplate in an article still goes.
    *[(f"<article><p>{STORY}</p><div class='{c}'><p>{STORY}</p></div><p>Yes.</p></article>", f"{S} Yes.") for c in (
        "cookie-notice", "related-posts", "newsletter-box", "ad", "sidebar left", "post-comments", "CookieNotice")],
    (f"<div class='site-header'><p>{STORY}</p></div><div id='discussion'><p>{STORY}</p></div><article><p>{STORY}</p></article>", S),
    # Quotes that do not pair up.
    (f"<article><p title='it's'>{STORY}</p><a href=\"x>link</a><p>Yes.</p></article>", f"{S} link Yes."),
    (f"<article><p>{STORY}</p><p>1 < 2 and 3 > 2</p></article>", f"{S} 1 < 2 and 3 > 2"),
]


@pytest.mark.parametrize("unit", ["<a ", "<a b='", "<a b=\"'", "<a '>", "<!", "<", "</", "<p class='", "<svg><style>", "<title>", "<button>",
                                  "<div>", "</section><div>", "<li><p>", "<a b=\"x'>", "<x '\">", "<td><tr>", "<!-- -->", "&amp", "<math><mi/>"])
def test_broken_markup_takes_linear_time(unit):
    tree = html_text.grown()
    times = []
    for size in (250_000, 1_000_000):
        start = time.process_time()
        html_text.main_text(f"<article><p>{STORY}</p>" + unit * (size // len(unit)), tree)
        times.append(time.process_time() - start)
    assert times[1] < 6 * times[0] + 0.5, times


def test_long_pages_of_open_tags():
    start = time.process_time()
    html_text.main_text("<a " * (5_000_000 // 3), html_text.grown())
    assert time.process_time() - start < 2


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(k):
    page, want = CASES[k]
    assert html_text.main_text(page, html_text.grown())[0] == want


def test_labels_are_learned():
    x, y = html_text.label_table()
    assert (html_text.grown().predict(x) == y).mean() > 0.98


def test_pages(spark):
    got = html_text.op5_html_text(spark, SF_MID).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        want = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner)))
        assert r["text"] == " ".join(want.split()) and r["n_chars"] == len(r["text"])


def test_clashing_and_empty(spark):
    pages = spark.createDataFrame([(1, None, "x", 5), (1, "<p>Hello there.</p>", "y", 6)], "page_id long, html string, _row string, n_chars int")
    got = html_text.extract(pages, keep_html=True)
    assert [(r["_row"], r["text"], r["n_chars"]) for r in got.orderBy("_row").collect()] == [("x", "", 0), ("y", "Hello there.", 12)]
    assert html_text.extract(pages.where("false")).count() == 0
