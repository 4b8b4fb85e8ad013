"""Pages whose text the tags do not name, and text around parts that are taken out."""

import time

from deskline.llm import line_blocks

P = [f"Paragraph {i} has a good number of words in it, so that it counts as text." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in P)
TEXT = "\n".join(P)
TEASERS = "".join(f"<div><article><a href=x>Teaser {i} of another text</a></article></div>" for i in range(3))


def test_article_is_a_weight_and_not_the_answer():
    assert line_blocks.main_text(f"<div id=content>{BODY}</div><div>{TEASERS}</div>") == TEXT
    assert line_blocks.main_text(f"<div>{TEASERS}</div><div id=content>{BODY}</div>") == TEXT
    assert line_blocks.main_text(f"<div>Elsewhere</div><article>{BODY}<p>End.</p></article><div>Our other pages</div>") == TEXT + "\nEnd."


def test_parts_hold_until_their_own_end():
    comment = "<article class='comment-body'><p>" + "A comment that goes on for many words. " * 5 + "</p></article>"
    for part in (
        f"<ol class='comment-list'><li>{comment}</li><li>{comment}</li></ol>",
        f"<aside>{comment}</aside>",
        f"<footer><div>{comment}</div></footer>",
        f"<nav>{comment}</nav>",
    ):
        assert line_blocks.main_text(f"<article>{BODY}</article>{part}") == TEXT, part
        assert line_blocks.main_text(f"{part}<article>{BODY}</article>") == TEXT, part
        assert line_blocks.main_text(f"<div>{BODY}</div>{part}") == TEXT, part
    # Without an end a part stops at the article; one that holds all there is is no part.
    assert line_blocks.main_text(f"<div class=ad>Buy<article>{BODY}</article>") == TEXT
    assert line_blocks.main_text(f"<div><div class=ad>Buy<article>{BODY}</article></div>") == TEXT
    assert line_blocks.main_text(f"<div><article>{BODY}<div class=ad>Buy</article></div><p>x</p>") == TEXT


def test_text_goes_on_after_parts_that_are_taken_out():
    for a, b in (("<div>", "</div>"), ("", ""), ("<article>", "</article>")):
        page = f"{a}<h1>Head</h1><div class='share'>Share it</div><p>By X.</p><div class=ad>Buy</div>{BODY}<div class=ad>Buy</div><p>End.</p>{b}"
        assert line_blocks.main_text(page) == f"Head\nBy X.\n{TEXT}\nEnd."
    page = f"<div><h1>Head</h1></div><form>x</form><div>{BODY}</div><div class=ad>Buy</div><div>Between.</div><aside>no</aside><div>{BODY}</div><aside>no</aside><div>Imprint</div>"
    assert line_blocks.main_text(page) == f"Head\n{TEXT}\nBetween.\n{TEXT}"


def test_linked_lines_within_the_text_are_text():
    links = "<p><a href=x>All of this line is a link.</a></p>"
    menu = "<ul><li><a href=a>Home page</a></li><li><a href=b>Other page</a></li></ul>"
    for n in (1, 5):
        got = line_blocks.main_text(f"{menu}<div>{BODY}{links * n}{BODY}</div>{menu}")
        assert got == "\n".join([TEXT, *["All of this line is a link."] * n, TEXT])


STORY = "The harbour was quiet in the morning and the boats lay still on the water, while the town above it slowly woke. " * 4


def _page(body, head="<head><title>x</title></head>"):
    return line_blocks.main_text(f"<html>{head}<body>{body}</body></html>")


def test_names_and_broken_markup_do_not_cost_the_article():
    whole = STORY.strip()
    assert _page(f"<article><p>{STORY}</p></article>", "<head><title>x</title><script>var t='</p>'</script>") == whole
    assert _page(f"<nav><a href=x>Home</a></nav><div class='elementor-widget-container'><p>{STORY}</p><p>{STORY}</p></div><footer>c</footer>") == f"{whole}\n{whole}"
    assert _page(f"<div class='content has-sidebar'><p>{STORY}</p></div><div class='sidebar'>other things here</div>") == whole
    assert _page(f"<main><div class='notice-board-article'><p>{STORY}</p></div></main>") == whole
    intro = "Short intro to the piece about the harbour that is long enough to count as text here."
    assert _page(f"<article><p>{intro}</p><button>Click<p>{STORY}</p><p>{STORY}</p></article>") == f"{intro}\n{whole}\n{whole}"
    prices = "Prices rose in the week after the announcement, and then they fell again by a little."
    assert _page(f"<article><p>{STORY}</p><section class='share-prices'><p>{prices}</p></section><p>{STORY}</p></article>") == f"{whole}\n{prices}\n{whole}"
    replies = "I do not agree with any of this at all, and I would like to say why in many words. " * 20
    assert _page(f"<article><p>{STORY}</p></article><div class='reader-replies'><p>{replies}</p></div>") == whole
    assert _page(f"<article><p>{STORY}</p></article><div class='share'><a href=x>Share this</a></div>") == whole
    assert _page(f"<p title='a < b > c'>{STORY}</p>") == whole


def test_broken_markup_takes_linear_time():
    start = time.time()
    for piece in ("<a x='", "<div class=a ", "</", "<button>", "<!--", "<", "<div class='x'>", "<head>", "<script>", "<a b=\"<"):
        line_blocks.main_text(f"<p>{STORY}</p>" + piece * (1_000_000 // len(piece)))
    assert time.time() - start < 60  # each quadratic one would take many minutes
