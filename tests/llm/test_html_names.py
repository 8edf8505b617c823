"""Names in class, id and role that stand on elements which hold the article."""

import pytest

from corpusmill.llm.htmltext import fitted_names, main_text

TEXT = "<h1>Old wells</h1><p>The wells of the town were dug by hand, and some still give water.</p>"
WANT = "Old wells\n\nThe wells of the town were dug by hand, and some still give water."


@pytest.mark.parametrize(
    "opening",
    ["body class='post has-sidebar'", "body class=sidebar", "div class='content with-sidebar'", "article id='search-result-3'", "main class='banner'",
     "div class='has-banner'", "section class='no-sidebar'", "div id='search-result-7'"],
)
def test_layout_names_leave_the_article(opening):
    name = opening.split()[0]
    page = f"<{opening}>{TEXT}</{name}>"
    assert main_text(page if name == "body" else f"<html><body><nav>a b</nav>{page}</body></html>") == WANT


@pytest.mark.parametrize("value", ["ad", "sidebar", "side-bar sidebar", "newsletter", "cookie-notice", "footer", "menu", "masthead", "popup", "disqus", "related-posts", "sponsor_links"])
def test_names_of_boilerplate_are_removed(value):
    assert main_text(f"<body><div>{TEXT}<div class='{value}'>buy this now</div></div></body>") == WANT


def test_names_are_weighed_by_the_pages():
    weights = fitted_names()
    assert weights["#known"] + weights["sidebar"] < 0 < min(weights["has"], weights["with"])


BODY = "<h1>Tides</h1>" + "".join(f"<p>Paragraph {i} tells of the tide and of the moon that draws it over the flats.</p>" for i in range(6))


def told(page):
    return main_text(page)


def test_a_form_around_the_page_is_no_boilerplate():
    inner = "<input type='hidden' name='state' value='x'><nav><a href='/'>start</a></nav>" + BODY + "<form><label>mail</label><input name='m'><button>send</button></form>"
    page = f"<html><body><form method='post' action='./page'>{inner}<input type='submit' value='go'></form></body></html>"
    text = told(page)
    assert text.startswith("Tides") and "Paragraph 5" in text and "start" not in text and "mail" not in text


def test_unclosed_anchors_do_not_swallow_the_article():
    for opening in ("<a name='top'>", "<a href='/x'>", "<a href='/x'>go"):
        text = told(f"<html><body>{opening}<div>{BODY}</div></body></html>")
        assert all(f"Paragraph {i}" in text for i in range(6)), opening


def test_an_articles_own_links_and_its_end_stay():
    links = "<h2>Reading list</h2><ul>" + "".join(f"<li><a href='/b{i}'>Book number {i} on tides</a></li>" for i in range(5)) + "</ul>"
    text = told(f"<html><body><nav><a href='/'>start</a></nav><article>{BODY}{links}<menu><li>one more thing to do</li></menu><p>The closing words are here, and they are the end of it.</p></article><footer>all rights</footer></body></html>")
    assert "Book number 4" in text and "closing words" in text and "one more thing" in text and "all rights" not in text and "start" not in text


def test_reviews_and_legal_notes_go():
    more = "<div class='user-reviews'><p>five stars from me for this tide</p></div><div id='discussion'><p>I saw it differently</p></div><div class='disclaimer'><p>no warranty for any tide</p></div><div class='legal'><p>all terms apply here</p></div>"
    text = told(f"<html><body><article>{BODY}{more}</article></body></html>")
    assert "Paragraph 5" in text and not any(w in text for w in ("five stars", "differently", "warranty", "terms apply"))
