"""Main text: planted pages, and the supplied pages against their marked articles."""

import html
import random
import re
import time

import pytest

from themeloom.llm.main_text import extract_main_text, main_text
from themeloom.llm.queries import op9_main_text

LONG = "This is a sentence of the story that is long enough to be told from a menu, number {}."


def page(body, head="<title>A title</title><style>p{}</style><script>var x='<p>no</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


AROUND = {
    "marked": ("<nav><a href=/>Home</a></nav><article>", "</article><footer>&copy; someone</footer>"),
    "classes": ('<div id="page-header">Site</div><ul class="menu main"><li><a href="#">One</a><li><a>Two</a></ul>'
                '<div class="content">', '</div><div class="comments"><p>' + LONG.format(99) + "</p></div>"),
    "roles": ('<div role="navigation">Some words about nothing</div><div role="main">',
              '</div><aside><p>' + LONG.format(98) + '</p></aside><form><p>' + LONG.format(97) + "</p></form>"),
    "plain": ("<p><a href=1>One</a> | <a href=2>Two</a></p>", "<p><a>Back</a></p>"),
}


@pytest.mark.parametrize("kind", list(AROUND))
def test_planted_pages(kind):
    rng = random.Random(kind)
    before, after = AROUND[kind]
    for _ in range(30):
        paragraphs = [LONG.format(k) * rng.randrange(1, 3) for k in range(rng.randrange(1, 8))]
        inner = "\n".join(
            f"<p>{p.replace('story', '<b>sto</b>ry &amp; &lt;tale&gt;')}</p>"
            + rng.choice(["", '<div class="ad">Buy this</div>', "<!-- <p>hidden</p> -->", '<div class="share">Share</div>'])
            for p in paragraphs
        )
        want = [p.replace("story", "story & <tale>") for p in paragraphs]
        assert main_text(page(before + inner + after)) == "\n".join(want)


def test_headings_and_short_paragraphs_of_an_article_stay():
    body = "<nav>x</nav><article><header><h1>Short</h1></header><p>One.<p>Two  \n words<br>here<ul><li>a</li><li>b</ul></article>"
    assert main_text(page(body)) == "Short\nOne.\nTwo words here\na\nb"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text(page("")) == main_text("<nav>only a menu</nav>") == ""
    assert main_text("just text &eacute; &#x41; &amp") == "just text é A &"
    assert main_text("<p>1 < 2 and <i class='x>y</i></p>") == "1 < 2 and y"
    assert main_text("<article><p>unclosed <b>bold") == "unclosed bold"
    assert main_text("<article><p>a</p><script>x") == "a"
    assert main_text("<article><p>a</p><!-- open") == "a"
    many = "<div>" * 5000 + LONG.format(1) * 2 + "</div>" * 5000
    assert main_text(many) == LONG.format(1) * 2
    assert len(main_text("<p>" + "word " * 200_000)) == 999_999


def test_supplied_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    found = op9_main_text(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.DOTALL)[1]
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", ""))]
        lines = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks]
        assert r.text == "\n".join(line for line in lines if line)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def test_null_rows_and_clashing_names(spark):
    rows = [(1, "u", None, "x", 1), (None, None, "<p>" + LONG, "x", 2), (None, None, "<p>" + LONG, "x", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_main_text(df).collect())
    assert found == [(0, LONG, len(LONG)), (0, LONG, len(LONG)), (1, "", 0)]
    assert extract_main_text(df.limit(0)).count() == 0


def test_a_mark_is_a_bonus_only():
    story = "\n".join(LONG.format(k) for k in range(6))
    told = "<div>" + "".join(f"<p>{line}</p>" for line in story.split("\n")) + "</div>"
    comment = f"<p>{LONG.format(99)}</p>"
    for kind in ('class="comment"', 'class="comment-body"', 'class="related"', 'class="ad"', 'role="complementary"', ""):
        assert main_text(page(f"{told}<article {kind}>{comment}</article>")) == story
        assert main_text(page(f"<article {kind}>{comment}</article>{told}")) == story
    for kind in ("article", "main"):
        assert main_text(page(f'<{kind}>{told}<article class="comment">{comment}</article></{kind}>')) == story
        assert main_text(page(f'<{kind} class="has-sidebar">{told}</{kind}><div>{comment}</div>')) == story
    assert main_text(page(f'<main class="sidebar-left">{told}</main>')) == story
    short = "<article><h1>Short</h1><p>One.</p><p>Two.</p></article>"
    assert main_text(page(f"{short}<div>{comment}</div>")) == "Short\nOne.\nTwo."


def test_edges_and_links_of_an_unmarked_story_stay():
    menu = "".join(f'<li><a href="{k}">Menu {k}</a></li>' for k in range(9))

    def links(n):
        return [f"Reference number {k}, see there" for k in range(n)]

    def body(lines):
        return "".join(f"<p><a href=#>{t}</a></p>" if t.startswith("Reference") else f"<p>{t}</p>" for t in lines)

    long = [LONG.format(k) for k in range(12)]
    for lines in (
        ["Title", "By A. Writer", "3 May", *long],
        ["Title", *long[:4], "A heading", *long[4:], "The end."],
        [*long[:2], *links(1), *long[2:4], *links(2), *long[4:]],
        [*long[:6], *links(3), *long[6:]],
        [*long[:1], *links(6), *long[1:]],
        [*long[:6], "See also", *links(12), "And then", *long[6:]],
        ["Title", *long[:3], *links(4), *long[3:6], *links(5), "Short.", *long[6:]],
    ):
        assert main_text(page(f"<ul>{menu}</ul>{body(lines)}<ul>{menu}</ul>")) == "\n".join(lines)
    story = "".join(f"<p>{line}</p>" for line in long[:6])
    cards = f"{story}<article><p>A card.</p></article>{story}"
    assert main_text(page(cards)) == "\n".join([*long[:6], "A card.", *long[:6]])
    posts = "<p>Next post</p>".join(f"<article><p>{line}</p></article>" for line in long[:3])
    assert main_text(page(posts)) == "\nNext post\n".join(long[:3])


STORY = ["The council met on Monday and spoke at length about the bridge over the river. " * 2] * 3


def _told(name, value):
    inner = "".join(f"<p>{text}</p>" for text in STORY)
    return f"<body><nav><a href=/>Home</a></nav><{name} class='{value}'>{inner}</{name}><div class='ad-slot'>Buy now</div></body>"


def test_a_word_of_a_longer_class_does_not_lose_the_story():
    want = "\n".join(text.strip() for text in STORY)
    for name, value in (("div", "layout-with-sidebar"), ("div", "has-sidebar"), ("section", "social-science"), ("div", "page no-banner")):
        assert main_text(_told(name, value)) == want
    # The words themselves, and comments however heavy, are no article.
    for value in ("sidebar", "comment-list", "comments"):
        page = _told("div", value).replace("</nav>", "</nav><div>" + "".join(f"<p>{text}</p>" for text in STORY[:1]) + "</div>")
        assert main_text(page) == STORY[0].strip()


def test_light_blocks_in_doubt_go():
    parts = [f"<p>{text}</p>" for text in STORY]
    page = f"<div class='with-sidebar'>{parts[0]}<div class='newsletter-box'><p>Write to us every week.</p></div>{''.join(parts[1:])}</div>"
    assert main_text(page) == "\n".join(text.strip() for text in STORY)


def test_many_unclosed_tags_take_linear_time():
    page = "<b>" * 100_000 + "</i>" * 100_000 + "<p>" + STORY[0]
    begun = time.process_time()
    assert main_text(page) == STORY[0].strip()
    assert time.process_time() - begun < 5
