"""Main texts of pages that the training leaves out: what an article may hold, and what stays out."""

from __future__ import annotations

import pytest

from plumbline.llm.html_extract import extract, trained

A, Z = "<p>First plain words of the article that go on for a while.</p>", "<p>The conclusion is here with some more words at the end.</p>"
FIRST, LAST = "First plain words of the article that go on for a while.", "The conclusion is here with some more words at the end."
SOLD = "<p>Readers who subscribe to the paper get it in the morning, all rights reserved as ever.</p>"
KEPT = "<p>A browser keeps cookies for each site that it visits and sends them back.</p>"

#: Body and its main text.
CASES = {
    "a section named Discussion": (f"<article><h1>T</h1>{A}<h2>Discussion</h2><p>We discuss things here at length, truly.</p><h2>Conclusion</h2>{Z}</article>", f"T {FIRST} Discussion We discuss things here at length, truly. Conclusion {LAST}"),
    "a section named Comments on": (f"<article><h1>T</h1>{A}<h2>Comments on the method</h2><p>Some remarks follow here.</p>{Z}</article>", f"T {FIRST} Comments on the method Some remarks follow here. {LAST}"),
    "Responses in main": (f"<main><h1>T</h1>{A}<h3>Responses</h3><p>Half of them answered in time.</p><p>Others did not answer at all.</p></main>", f"T {FIRST} Responses Half of them answered in time. Others did not answer at all."),
    "Discussion in a neutral container": (f"<div><h1>T</h1>{A}<h2>Discussion</h2><p>We discuss things here at length, truly.</p><h2>Conclusion</h2>{Z}</div>", f"T {FIRST} Discussion We discuss things here at length, truly. Conclusion {LAST}"),
    "cookies amid prose": (f"<div><h1>T</h1>{A}{KEPT}{Z}</div>", f"T {FIRST} {KEPT[3:-4]} {LAST}"),
    "subscribe amid prose": (f"<div><h1>T</h1>{A}{SOLD}{Z}</div>", f"T {FIRST} {SOLD[3:-4]} {LAST}"),
    "a paragraph of links only": ("<article><h1>Sources</h1><p>See <a href='/a'>the first long source</a> and <a href='/b'>the second one</a>.</p></article>", "Sources See the first long source and the second one."),
    "a paragraph that is one link": (f"<article><h1>T</h1>{A}<p><a href='/a'>A whole paragraph that is one link</a></p>{Z}</article>", f"T {FIRST} A whole paragraph that is one link {LAST}"),
    "a linked heading": (f"<article><h1>T</h1>{A}<h2><a href='/a'>A linked heading</a></h2>{Z}</article>", f"T {FIRST} A linked heading {LAST}"),
    "a list of references": (f"<article><h1>T</h1>{A}<h2>References</h2><ul><li><a href='/a'>One work</a></li><li><a href='/b'>Another work</a></li></ul></article>", f"T {FIRST} References One work Another work"),
    "a class that says more": (f"<article><h1>T</h1>{A}<div class='read-more-content'>{Z}</div></article>", f"T {FIRST} {LAST}"),
    "comments with marks": (f"<article><h1>T</h1>{A}{Z}<h3>3 comments</h3><div><b>Ann</b><span>2 hours ago</span><p>Nice one.</p></div><div><b>Bob</b><span>3 hours ago</span><p>Not so nice.</p></div></article>", f"T {FIRST} {LAST}"),
    "comments by class": (f"<article><h1>T</h1>{A}{Z}</article><section class='comments'><h3>Comments</h3><p>Nice one.</p></section>", f"T {FIRST} {LAST}"),
    "comments with parts": (f"<div><h1>T</h1>{A}{Z}</div><h3>Responses</h3><ul><li><b>Ann</b><p>Nice one.</p></li><li><b>Bob</b><p>Not so nice.</p></li></ul>", f"T {FIRST} {LAST}"),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    body, want = CASES[name]
    page = f"<!DOCTYPE html><html><head><title>x</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>{body}<footer>© 2020 All rights reserved</footer></body></html>"
    assert extract([page], trained()) == [want]
