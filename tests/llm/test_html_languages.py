"""Main text in scripts and languages without stop words in the list, and state classes of wrappers."""

import pytest

from tremorlake.llm.html_text import extract

RUSSIAN = "Сильное землетрясение произошло ночью у берегов острова, жители нескольких посёлков покинули дома и ждали утра на холмах. " * 2
POLISH = "Silne trzęsienie ziemi nawiedziło dziś rano wybrzeże wyspy, mieszkańcy opuścili swoje domy oraz czekali całą noc pod wzgórzami. " * 2
CHINESE = "昨夜该岛沿海发生强烈地震，数个村庄的居民离开家园，在山上等待天亮。救援人员已经赶到现场，目前没有人员伤亡的报告，余震仍在继续，请大家注意安全。"
ARABIC = "ضرب زلزال قوي سواحل الجزيرة الليلة الماضية وغادر سكان عدة قرى منازلهم وانتظروا الصباح فوق التلال القريبة من البحر. " * 2
ENGLISH = "The harbour was closed for the day and all of the boats that were at sea came back to it before it was dark. " * 3


@pytest.mark.parametrize("text", [RUSSIAN, POLISH, CHINESE, ARABIC])
def test_articles_of_other_languages_stay(text):
    text = text.strip()
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"
    assert extract(f"<nav>{text}</nav><div><p>{text}</p><p>{text}</p></div>{menu}") == f"{text}\n\n{text}"
    inside = extract(f"<article><p>{text}</p><p><a href=x>{text}</a></p><p>{text}</p></article>")
    assert inside == f"{text}\n\n{text}"


def test_a_link_dense_block_does_not_take_the_open_article_with_it():
    plain = "Magnitude six point four, depth eleven kilometres, origin offshore north-east, intensity five, aftershocks twenty-three."
    got = extract(f"<article><p>{plain}</p><p><a href=x>{plain}</a></p></article><div><p>{ENGLISH}</p></div>")
    assert plain in got and got.count(plain) == 1


@pytest.mark.parametrize("name", ["content has-sidebar", "comments-open", "layout-with-sidebar", "no-sidebar post"])
def test_state_classes_do_not_mark_a_wrapper(name):
    assert extract(f'<div class="{name}"><p>{ENGLISH}</p></div>') == ENGLISH.strip()


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "cookie-banner wide", "comments"])
def test_boilerplate_classes_still_do(name):
    assert extract(f'<div class="{name}"><p>{ENGLISH}</p></div>') == ""


def test_listed_languages_keep_their_stop_word_rule():
    junk = "Copyright 2024 Example Publishing Incorporated. Registered trademarks, London, Paris, Berlin, Madrid, Rome."
    assert extract(f"<div><p>{ENGLISH}</p></div><section><p>{junk}</p></section>") == ENGLISH.strip()
