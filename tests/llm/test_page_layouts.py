"""Pages in layouts that the model has not seen: what it must keep and what it must leave out."""

import time

import pytest

from scanloom.llm import html_extraction

TITLE = "Water for the upper town"
TEXT = [
    "The committee met on Thursday to talk about the water supply of the upper town, and the meeting lasted until midnight.",
    "Nothing was decided. Several members asked for a second report, which is to be ready before the end of the summer.",
    "In the meantime the old pipes will be kept in use, although everybody agrees that they should have been replaced long ago.",
]
H1 = f"<h1>{TITLE}</h1>"
PS = "".join(f"<p>{x}</p>" for x in TEXT)
NAV = '<ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">Contact</a></li></ul>'
LAYOUTS = {
    "div in main": f"<main><div>{PS}</div></main>",
    "section": f"<section>{PS}</section>",
    "one div": f"<div>{H1}{PS}</div>",
    "id of two words": f"<div id='bodyContent'>{H1}{PS}</div>",
    "bare divs, header, footer": f"<header>{NAV}</header><div>{H1}{PS * 6}</div><footer><p>Copyright 2020</p></footer>",
    "deep bare divs": f"<div><div>{NAV}</div><div><div><div>{H1}{PS}</div></div></div></div>",
    "ids with hyphens": f"<div id='mw-panel'>{NAV}</div><div id='mw-content-text'>{H1}{PS}</div>",
    "table layout": f"<table><tr><td>{NAV}</td><td>{H1}{PS}</td></tr></table>",
    "unknown ids": f"<div id='zone1'>{NAV}</div><div id='zone2'>{H1}{PS}</div><div id='zone3'><a href=x>Imprint</a></div>",
    "divs for paragraphs": f"<div>{NAV}</div><div>{''.join(f'<div>{x}</div>' for x in TEXT)}</div>",
    "paragraphs in the body": H1 + PS,
    "text in the body": f"{TEXT[0]}<br>{TEXT[1]}",
    "preformatted": f"<pre>{TEXT[0]}\n{TEXT[1]}</pre>",
    "sections in a div": f"<div>{''.join(f'<section><h2>Part</h2><p>{x}</p></section>' for x in TEXT)}</div>",
    "generated classes": f"<div class='sc-1x2y'><div class='css-abc'>{NAV}</div><div class='css-def'>{H1}{PS}</div></div>",
    "old elements": f"<center><font size=3>{TEXT[0]}<p>{TEXT[1]}<p>{TEXT[2]}</font></center>",
    "cells": f"<table><tr><td>{TEXT[0]}</td></tr><tr><td>{TEXT[1]}</td></tr></table>",
    "article in bare divs": f"<div><div><article>{H1}{PS}</article></div></div>",
    "comments below": f"<div>{H1}{PS}</div><div class='comments'><p>I think this is a scandal, and somebody ought to resign.</p></div>",
    "sidebar": f"<div><div>{H1}{PS}</div><div class='sidebar'><h3>News</h3><p>Read our new letter about the region each week.</p></div></div>",
    "terms": f"<div><dl><dt>Pipes</dt><dd>{TEXT[0]}</dd><dt>Wells</dt><dd>{TEXT[1]}</dd></dl></div>",
    "numbered list": f"<div>{NAV}</div><div>{H1}<ol>{''.join(f'<li>{x}</li>' for x in TEXT)}</ol></div>",
    "link in the text": f"<div>{NAV}</div><div><p>{TEXT[0]} <a href=x>See the plan</a>.</p><p>{TEXT[1]}</p></div>",
}
BOILERPLATE = ("Home", "About us", "Contact", "Copyright", "Imprint", "scandal", "our new letter")


@pytest.fixture(scope="module")
def model():
    return html_extraction.train()


@pytest.mark.parametrize("layout", LAYOUTS)
def test_article_of_an_unseen_layout_stays_whole(model, layout):
    html = f"<html><body>{LAYOUTS[layout]}</body></html>"
    text = html_extraction.extract(html, model)
    assert [x for x in [TITLE, *TEXT] if x in html] == [x for x in [TITLE, *TEXT] if x in text]
    assert not [x for x in BOILERPLATE if x in text]


def test_nothing_but_boilerplate_gives_nothing(model):
    for html in (f"<div>{NAV}</div>", f"<header>{NAV}</header><footer><p>Copyright</p></footer>", "<div class='ad'>Buy two, pay one.</div>"):
        assert html_extraction.extract(f"<body>{html}</body>", model) == ""


@pytest.mark.parametrize("part", [
    "<a " * 100_000, "<a \"'" * 100_000, "<div>" * 20_000 + "</section>" * 20_000, "<div>" * 20_000 + "<li>" * 20_000,
    "<p " + "a" * 2_000_000 + ">", "<p a" + " " * 1_000_000 + ">", "<script>" * 100_000, "<select>" * 10_000 + "<div>" * 10_000,
])
def test_long_odd_pages_take_time_in_proportion(model, part):
    began = time.process_time()
    assert html_extraction.extract(f"<main><p>{TEXT[0]}</p>{part}", model).startswith(TEXT[0])
    assert time.process_time() - began < 20
