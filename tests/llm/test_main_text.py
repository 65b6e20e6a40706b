"""Pages whose main text the tags alone don't tell."""

from __future__ import annotations

import time

from pricegrain.llm.html_text import main_text

STORY = "The council met for six hours before it agreed on the plan, and the streets stayed full until the last lamps went out. "


def test_story_outside_article():
    page = f"<body><h1>Night of the plan</h1><div><p>{STORY}</p><p>{STORY}</p></div><hr><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul><article><p>Card of another story</p></article></body>"
    assert main_text(page).startswith(f"Night of the plan {STORY.strip()} {STORY.strip()}")


def test_linked_lines_within_the_story():
    page = f"<body><article><h1><a href=x>Linked heading</a></h1><p>{STORY}</p><p><a href=y>A source, as a link</a></p><h2><a href=z>Second</a></h2><p>{STORY}</p></article><footer>foot</footer></body>"
    assert main_text(page) == f"Linked heading {STORY.strip()} A source, as a link Second {STORY.strip()}"


def page(*blocks: str) -> str:
    return "<html><head><title>t</title></head><body>" + "".join(blocks) + "</body></html>"


TEASERS = "<div class=x1><h3>More for you</h3><p>A short teaser</p><p>Another one</p><ul><li>and a third</li><li>and a fourth</li></ul></div>"
MENU = "<div class=x0><ul>" + "".join(f"<li><a href=/{i}>Topic number {i} of this site</a></li>" for i in range(9)) + "</ul></div>"
COMMENTS = "<section class='comment-list'>" + f"<div><b>someone</b><p>{STORY}</p></div>" * 3 + "</section>"


def test_windows_choose_the_text_without_telling_names():
    story = f"<div class=x2><h1>Night of the plan</h1><p>{STORY}</p><p>Short.</p><p>{STORY}</p></div>"
    want = f"Night of the plan {STORY.strip()} Short. {STORY.strip()}"
    assert main_text(page(MENU, story, TEASERS)) == want
    assert main_text(page(MENU, TEASERS, story, COMMENTS)) == want
    # Without the windows (one that never lets go, or a surge that everything reaches) the boxes come along.
    assert main_text(page(MENU, story, TEASERS), window=50) != want and main_text(page(MENU, story, TEASERS), surge=1) != want


def test_one_text_in_single_blocks_and_in_sections():
    divided = "".join(f"<div>{t}</div>" for t in (STORY, "Short.", STORY, "End."))
    assert main_text(page(MENU, f"<div class=x2>{divided}</div>", TEASERS)) == f"{STORY.strip()} Short. {STORY.strip()} End."
    inside = f"<article><section><h2>One</h2><p>{STORY}</p></section><aside><p>box</p><p>box</p><p>box</p></aside><section><h2>Two</h2><p>End.</p></section></article>"
    assert main_text(page(MENU, inside, TEASERS, COMMENTS)) == f"One {STORY.strip()} Two End."


def test_odd_pages():
    assert [main_text(x) for x in ("", "   ", "<p>", "<nav>menu</nav>", "<article><nav>menu</nav></article>")] == [""] * 5
    assert main_text("plain &amp; bare") == "plain & bare" and main_text("<p>one<p>two</div>") == "one two"
    assert main_text(page(f"<p>{'long word ' * 40_000}</p>")).count("word") == 40_000


def test_names_alone_empty_no_page():
    assert main_text(f"<div id='social-studies-lesson'><p>{STORY}</p></div>") == STORY.strip()
    assert main_text(page(MENU, f"<div class='story-notice'><p>{STORY}</p></div>")) == STORY.strip()
    assert main_text("<nav>menu</nav><div hidden>gone</div>") == ""


def test_articles_within_an_article_are_comments():
    nested = f"<article><h1>One</h1><p>{STORY}</p><section><article><p>A reader: {STORY}</p></article></section></article>"
    assert main_text(page(MENU, nested)) == f"One {STORY.strip()}"
    assert main_text(page(f"<article><article><p>{STORY}</p></article></article>")) == STORY.strip()


def test_deep_and_broken_pages_take_linear_time():
    for broken in ("<div>" * 200_000, "<b>" * 50_000 + "<div>" * 50_000 + "</b>x" * 50_000, "<svg>x" * 120_000, "<div>" * 100_000 + "</p>x" * 60_000, '<a x="' * 150_000, "<!--" * 200_000):
        start = time.process_time()
        main_text(broken)
        assert time.process_time() - start < 10
    assert main_text("<div>" * 50_000 + STORY) == STORY.strip()
