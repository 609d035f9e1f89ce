"""Names of layout wrappers don't take the article with them; dense parts beside an article stay."""

import pytest

from netweir.llm.text_density import main_text

LONG = "A sentence that is long enough to count as text of an article, said twice over for good measure. "
S = LONG.strip()


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "content-with-sidebar", "with-comments", "layout-sidebar", "sidebar"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers(name, tag):
    page = f"<body><div id=page class='{name}'><{tag}><p>{LONG}<p>{LONG}</{tag}><div class='sidebar'>side</div></div><p><a href=x>one</a></p>"
    assert main_text(page).split("\n")[:2] == [S, S] and "side" not in main_text(page).split("\n")


def test_article_with_category():
    page = f"<body><article class='post category-notices tag-advertising'><p>{LONG}<p>{LONG}</article><div class='ad-slot'>Buy</div><div class='ad'>Buy</div>"
    assert main_text(page) == f"{S}\n{S}"


def test_long_comments_go_beside_an_article():
    page = f"<body><article><p>{LONG}</article><div class='comments'>{f'<p>{LONG}x' * 9}</div>"
    assert main_text(page) == S


def test_dense_parts_beside_the_first_article():
    page = f"<body><article><p>{LONG * 3}</article><article><p>{LONG * 2}</article><div>{'<a href=x>link text</a> ' * 20}</div>"
    assert main_text(page).split("\n") == [(LONG * 3).strip(), (LONG * 2).strip()]
