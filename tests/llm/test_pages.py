"""Kinds of pages, made by hand: the article whole, and nothing else."""

import pytest

from galley.llm.html_extract import main_text

S = [f"Sentence number {k} of the article says something new, and at some length too." for k in range(6)]
TEXT = " ".join(S[:4])
P = "".join(f"<p>{s}</p>" for s in S[:4])
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More things</a></li></ul></nav>"
FOOT = "<footer>&copy; Someone. All rights reserved.</footer>"
LINKS = "<ul><li><a href='/1'>First other story</a></li><li><a href='/2'>Second other story</a></li></ul>"
OPINIONS = "".join(f"<div class='comment'><p>I do not agree with that at all, number {k}. It was better before, you know.</p></div>" for k in range(9))


def page(body):
    return f"<html><head><title>T</title></head><body>{NAV}{body}{FOOT}</body></html>"


SAME = {
    "article": f"<article>{P}</article>",
    "main": f"<main>{P}</main>",
    "no container": P,
    "divs": f"<div><div>{P}</div></div>",
    "overflow": f"<div class='overflow-hidden'><article>{P}</article></div>",
    "overflow style": f"<div style='overflow: hidden'><article>{P}</article></div>",
    "not hidden": f"<div aria-hidden='false'><article>{P}</article></div>",
    "state": f"<div data-state='hidden'><article>{P}</article></div>",
    "hidden in a value": f"<div title='the hidden side' data-x='display:none'><article>{P}</article></div>",
    "has sidebar": f"<div class='layout has-sidebar'><article>{P}</article></div>",
    "with sidebar": f"<div class='page-with-sidebar'><article>{P}</article></div>",
    "no sidebar": f"<main class='content no-sidebar'>{P}</main>",
    "search theory": f"<main id='search-theory'>{P}</main>",
    "allow comments": f"<article class='post allow-comments'>{P}</article>",
    "page form": f"<form action='/' id='aspnetForm'><input name='x'><article>{P}</article></form>",
    "page form, divs": f"<form id='aspnetForm'><div>{P}</div></form>",
    "wrapper with a bad name": f"<div class='widget'><h1>{S[0]}</h1><p>{S[1]}</p><p>{S[2]}</p><p>{S[3]}</p></div>",
    "related work": f"<article><p>{S[0]}</p><p>{S[1]}</p><section id='related-work'><p>{S[2]}</p><p>{S[3]}</p></section></article>",
    "social history": f"<article><p>{S[0]}</p><div class='social-history'><p>{S[1]}</p><p>{S[2]}</p></div><p>{S[3]}</p></article>",
    "sections": f"<article><section><p>{S[0]}</p><p>{S[1]}</p></section><section><p>{S[2]}</p><p>{S[3]}</p></section></article>",
    "two articles": f"<article><p>{S[0]}</p><p>{S[1]}</p></article><article><p>{S[2]}</p><p>{S[3]}</p></article>",
    "intro and main": f"<div class='content'><section class='intro'><p>{S[0]}</p><p>{S[1]}</p></section><section class='main'><p>{S[2]}</p><p>{S[3]}</p></section></div>",
    "named divs": "".join(f"<div class='part{k}'><p>{s}</p></div>" for k, s in enumerate(S[:4])),
    "header inside": f"<article><header><h1>{S[0]}</h1></header><p>{S[1]}</p><p>{S[2]}</p><p>{S[3]}</p></article>",
    "list": f"<article><p>{S[0]}</p><ul><li>{S[1]}</li><li>{S[2]}</li></ul><p>{S[3]}</p></article>",
    "table": f"<article><p>{S[0]}</p><table><tr><td>{S[1]}</td><td>{S[2]}</td></tr></table><p>{S[3]}</p></article>",
    "quote": f"<article><p>{S[0]}</p><blockquote>{S[1]}</blockquote><p>{S[2]}</p><p>{S[3]}</p></article>",
    "links in prose": f"<article><p>{S[0]}</p><p>{S[1][:20]}<a href='/'>{S[1][20:40]}</a>{S[1][40:]}</p><p>{S[2]}</p><p>{S[3]}</p></article>",
    "inline": f"<article><p>{S[0]}</p><p><b>{S[1][:9]}</b>{S[1][9:]}</p><p>{S[2]}</p><p>{S[3]}</p></article>",
    "advert": f"<article><p>{S[0]}</p><div class='ad'>Buy this now. It is cheap.</div><p>{S[1]}</p><p>{S[2]}</p><p>{S[3]}</p></article>",
    "advert with utilities": f"<div class='mt-4 ad-slot'>Buy this now. It is cheap.</div><article>{P}</article>",
    "cookie notice": f"<div id='cookie-notice'><p>We use cookies. Please accept them all, or read on without.</p></div><article>{P}</article>",
    "sidebar": f"<div class='wrap'><article>{P}</article><div class='sidebar'><h2>Other</h2>{LINKS}</div></div>",
    "aside": f"<article>{P}</article><aside>Something beside it. Read it too.</aside>",
    "related list": f"<article>{P}<div class='related-posts'>{LINKS}</div></article>",
    "weak list": f"<article>{P}<div class='related-gizmos'>{LINKS}</div></article>",
    "comments": f"<article>{P}</article><section id='comments'>{OPINIONS}</section>",
    "comments in main": f"<main>{P}<div class='comments-area'>{OPINIONS}</div></main>",
    "comments as articles": f"<article class='post'>{P}</article>" + OPINIONS.replace("div", "article"),
    "camel case": f"<article>{P}</article><div class='commentList'>{OPINIONS}</div>",
    "newsletter form": f"<article>{P}<form class='signup'><label>Your address, please. We never share it.</label></form></article>",
    "search form": f"<form role='search'><label>Search all of this site.</label></form><article>{P}</article>",
    "hidden": f"<article>{P}<p hidden>Not for you. Not at all.</p><p style='color:red;display: none'>Nor this. No.</p></article>",
    "aria hidden": f"<article>{P}<p aria-hidden='true'>Not for you. Not at all.</p></article>",
    "share buttons": f"<article>{P}<div class='share-buttons'><a href='/f'>Share it</a> <a href='/t'>Send it</a></div></article>",
    "page header": f"<header><h1>The Daily Paper</h1><p>News of the day. Every day.</p></header><article>{P}</article>",
    "script": f"<article>{P}<script>var a = '<p>no</p>. No.';</script><style>p {{ color: red. }}</style></article>",
}


@pytest.mark.parametrize("kind", SAME)
def test_the_article_comes_out_whole_and_clean(kind):
    assert main_text(page(SAME[kind])) == TEXT


@pytest.mark.parametrize("body", ["", "<div class='ad'>Buy this now. It is cheap.</div>", "<form><label>Your name, please.</label></form>",
                                  "<div class='cookie-consent'><p>We use cookies. Accept them.</p></div>", "<!-- nothing -->"])
def test_pages_without_an_article_are_empty(body):
    assert main_text(page(body)) == ""
