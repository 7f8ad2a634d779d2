"""Main text of pages: layouts that keep text, layouts that lose it, ratios and regions by a plain second implementation, deep pages."""

import math
import time

import numpy as np
import pytest

from memloom.llm import html

LINE = "Some words of a paragraph that is long enough to be the text of this page, with more to follow."
BODY = "".join(f"<p>{k} {LINE}</p>" for k in range(6))
TEXT = "\n".join(f"{k} {LINE}" for k in range(6))
PAPER = "".join(f"<h2>{name}</h2><p>{name} {LINE}</p><p>{LINE}</p>" for name in ("Results", "Discussion", "Conclusion"))
PAPER_TEXT = "\n".join(f"{name}\n{name} {LINE}\n{LINE}" for name in ("Results", "Discussion", "Conclusion"))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><form id='aspnetForm' method=post><div>{BODY}</div></form></body>", TEXT),
        (f"<body><form action='/'><div class=nav><a href=/>Home</a></div><div>{BODY}</div></form><footer><p>{LINE}</p></footer></body>", TEXT),
        (f"<article><h1>Kommentar</h1>{BODY}</article>", f"Kommentar\n{TEXT}"),
        (f"<article><h2>Discussion</h2>{BODY}</article>", f"Discussion\n{TEXT}"),
        (f"<article><h1>Comments</h1>{BODY}</article>", f"Comments\n{TEXT}"),
        (f"<article><h1>T</h1>{PAPER}</article>", f"T\n{PAPER_TEXT}"),
        (f"<article><h1>T</h1><p>{LINE}</p><h2>Reply</h2>{BODY}</article>", f"T\n{LINE}\nReply\n{TEXT}"),
        (f"<body><h1>Title</h1><p>By A. Writer</p><p>May 4</p><p>A short lead.</p>{BODY}<p>That is all.</p><p>More soon.</p></body>", f"Title\nBy A. Writer\nMay 4\nA short lead.\n{TEXT}\nThat is all.\nMore soon."),
        (f"<body><div>{BODY}<p><a href=x>One whole paragraph that is a link</a></p>{BODY}</div></body>", f"{TEXT}\nOne whole paragraph that is a link\n{TEXT}"),
        (f"<main><section class='form-of-life'><p>{LINE}</p></section>{BODY}</main>", f"{LINE}\n{TEXT}"),
    ],
)
def test_text_is_kept(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("name", "article-comments post-comments fb-comments wp-block-latest-comments article-footer post-footer blog-sidebar article-share byline-share-tools story-ad gdpr-notice right-rail author-bio".split())
def test_names_of_parts(name):
    for element in ("div", "section"):
        assert html.main_text(f"<article>{BODY}<{element} class='{name}'><p>{LINE}</p></{element}></article>") == TEXT
        assert html.main_text(f"<body><div>{BODY}</div><{element} id='{name}'><p>{LINE}</p></{element}></body>") == TEXT


@pytest.mark.parametrize(
    "part",
    [
        f"<div style='color:red; display: none'><p>{LINE}</p></div>",
        f"<p aria-hidden=true>{LINE}</p>",
        f"<div aria-hidden='true'><p>{LINE}</p></div>",
        f"<p hidden>{LINE}</p>",
        f"<form><p>{LINE}</p><input name=a><button>Send</button></form>",
        f"<div role='complementary'><p>{LINE}</p></div>",
        f"<div><h3>12 replies</h3><p>{LINE}</p></div>",
        f"<h3>Leave a comment</h3><p>{LINE}</p>",
        f"<div class='user-comments'>{BODY * 9}</div>",
        "<nav>" + "".join(f"<li><a href=x>{LINE}</a></li>" for _ in range(80)) + "</nav>",
    ],
)
def test_parts_that_are_no_text(part):
    assert html.main_text(f"<article>{BODY}{part}</article>") == TEXT


def test_ends_of_a_body():
    page = f"<body><p><a href=/>Home</a></p><p><a href=/a>About</a></p><h1>Title</h1>{BODY}<p>The end.</p><p>Copyright 2020 by us</p><div>Something else</div></body>"
    assert html.main_text(page) == f"Title\n{TEXT}\nThe end."
    assert html.main_text("<nav><ul><li><a href=/>Home</a><li><a href=/b>Away</a></ul></nav>") == ""


def plain_clusters(lines, sigma):
    """Ratios, smoothing and threshold number by number."""
    ratio = [max(0, len(text) - links) / max(1, tags) for text, tags, links, _ in lines]
    reach = math.ceil(3 * sigma)
    weight = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    smooth = [sum(w * ratio[min(max(i + d, 0), len(ratio) - 1)] for w, d in zip(weight, range(-reach, reach + 1), strict=True)) / sum(weight) for i in range(len(ratio))]
    mean = sum(smooth) / len(smooth)
    limit = min(mean, math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)))
    return [x >= limit for x in smooth], limit, smooth


def plain_region(page, dense):
    """The region by walking up from each line."""

    def chain(c):
        out = []
        while c >= 0:
            out.append(c)
            c = page.parents[c]
        return out

    weight = [0] * len(page.kinds)
    for line, d in zip(page.lines, dense, strict=True):
        for c in chain(line[3]):
            weight[c] += len(line[0]) * d
    articles = [c for c in range(len(weight)) if page.kinds[c] in html.ARTICLE and 2 * weight[c] >= weight[0]]
    if not articles:
        return max(c for c in range(len(weight)) if weight[c] == weight[0])
    region = articles[-1]
    for c in reversed(articles[:-1]):
        inside = [k for k, line in enumerate(page.lines) if region in chain(line[3])]
        if c in chain(region) and (weight[c] > weight[region] or any(page.blocks[k] in html.HEADINGS and c in chain(page.lines[k][3]) for k in range(inside[0]))):
            region = c
    return region


def random_page(rng, depth=0):
    out = []
    for _ in range(int(rng.integers(1, 5))):
        kind = int(rng.integers(0, 8))
        words = " ".join(["word"] * int(rng.integers(1, 40)))
        if kind < 3 or depth > 4:
            out.append(f"<p>{words}</p>")
        elif kind == 3:
            out.append(f"<ul><li><a href=x>{words}</a><li>{words}</ul>")
        elif kind == 4:
            out.append(f"<h2>{words}</h2>")
        else:
            tag = ("div", "article", "section", "main")[int(rng.integers(0, 4))]
            out.append(f"<{tag}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_ratios_and_regions_against_plain_code():
    rng = np.random.default_rng(3)
    articles = 0
    for _ in range(300):
        source = f"<body>{random_page(rng)}</body>"
        page = html.Lines()
        page.feed(source)
        page.finish()
        dense, limit, smooth = plain_clusters(page.lines, html.SIGMA)
        found = html.clusters(page.lines).tolist()
        assert all(a == b or abs(s - limit) < 1e-9 for a, b, s in zip(found, dense, smooth, strict=True))
        region = plain_region(page, found)
        articles += page.kinds[region] in html.ARTICLE
        if page.kinds[region] in html.ARTICLE:

            def inside(c):
                while c > region:
                    c = page.parents[c]
                return c == region

            assert html.main_text(source) == "\n".join(line[0] for line in page.lines if inside(line[3]))
    assert articles > 50


def test_deep_pages_take_time_that_grows_with_them():
    took = []
    for depth in (3000, 12000):
        began = time.process_time()
        for tag in ("div", "article"):
            html.main_text(f"<{tag}>" * depth + "<p>hello there</p>" * depth)
            html.main_text("".join(f"<{tag}><p>hello there {k}</p>" for k in range(depth)))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_rows(spark):
    rows = [(1, "u", None, "t", 3), (2, None, "", "t", 3), (None, "v", f"<article>{BODY}</article>", "t", 3), (4, "w", "<p>a\n b", "t", 3), (4, "w", "<p>a\n b", "t", 3)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", TEXT, len(TEXT)), (4, "w", "a b", 3), (4, "w", "a b", 3)], key=str)
