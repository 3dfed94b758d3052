"""Page text: whole kinds of pages that rules by name or tag could lose, and broken pages in linear time."""

import time

import pytest

from tremorlake.llm.html_text import extract

PARAGRAPHS = [f"The {w} of the town was not in the plan that they had made for the year, and it is on the list of all that was to be done with it, said one of those who were in the room at the time of the vote, which was long." for w in
              ("bridge", "harbour", "school", "library")]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n\n".join(PARAGRAPHS)


@pytest.mark.parametrize("page", [
    f"<html><body><form id=aspnetForm action='/'><div>{ARTICLE}</div></form></body></html>",
    f"<body><form id=f><header>Site</header><article>{ARTICLE}</article></form></body>",
    f"<body><datalist><option value=a><option value=b></datalist><div>{ARTICLE}</div></body>",
    f"<body><select><option>one<option>two</select><div>{ARTICLE}</div></body>",
    f"<body><!--><div>{ARTICLE}</div></body>", f"<body><!---><div>{ARTICLE}</div></body>", f"<body><!-- a > b -- c --!><div>{ARTICLE}</div></body>",
    f"<body><div class='social-science'>{ARTICLE}</div></body>", f"<body><div id=main-menu-page>{ARTICLE}</div></body>",
    f"<body><div class='lead notice-of-death'>{ARTICLE}</div></body>",
    f"<body><svg/><div>{ARTICLE}</div></body>", f"<body><svg><title>Icon</title><text>Go</text></svg><div>{ARTICLE}</div></body>",
    f"<body><div class=userComments><p>{PARAGRAPHS[0][:-1]}, I think.</p></div><div>{ARTICLE}</div></body>",
    f"<body><div>{ARTICLE}</div><form class=x><label>Mail</label><p>Write to us and we will be in touch with you as it is of use for all.</p><input></form></body>",
    f"<body><p class=don't></p><div>{ARTICLE}</div><script>if (a < b) document.write('<p>' + x)</script></body>",
    f"<body><? echo 1 ?><![CDATA[x]]></3><div>{ARTICLE}</div></body>"])
def test_articles_are_kept_whole(page):
    assert extract(page) == TEXT


@pytest.mark.parametrize("unit", ["<a ", "<!", "<a '", "<a \"", "<!--", "</", "<script", "<form>", "<svg><select>", "</div x", "<p class=\"", "<a <b '>"])
def test_broken_pages_take_linear_time(unit):
    start = time.perf_counter()
    extract(f"<div>{ARTICLE}</div>" + unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 20


def test_unclosed_raw_text_takes_the_rest():
    assert extract(f"<div>{ARTICLE}</div><script>{ARTICLE}") == TEXT
