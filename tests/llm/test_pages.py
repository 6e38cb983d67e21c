"""Pages that the generator of training pages did not make, and pages that are broken or enormous."""

import time

import pytest

from tests.llm.hand_pages import PAGES
from terrane.llm import htmltext

BLOG = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><a href=/>Home</a> <a href=/about>About</a></nav><article><h1>Title here</h1>
<p title="the hidden cost of it">First paragraph of it, long enough to be one.</p><div class="note hidden gem"><p>Second paragraph with a <a href=x>link</a>.</p></div>
<p>Energy is <math><mi>E</mi></math> equal to mass.</p><ul><li>one thing<li>another thing</ul></article>
<h3>2 Comments</h3><ol class="commentlist"><li>Anna says: <p>I like this post very much, thanks for it.</p></li><li>Bob: <p>Not so good.</p></li></ol>
<div id="secondary"><h3>Archives</h3><ul><li><a href=x>May 2010</a></li></ul></div><footer>&copy; me</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return htmltext.train()


def test_a_blog(model):
    text = htmltext.main_text(BLOG, model)[0]
    assert text == "Title here First paragraph of it, long enough to be one. Second paragraph with a link. Energy is E equal to mass. one thing another thing"


@pytest.mark.parametrize("comments", ['<div id="disqus_thread">{}</div>', '<section class="usercomments">{}</section>', '<ul class="comment-thread">{}</ul>'])
@pytest.mark.parametrize("main", ["<article>{}</article>", '<main><div class="story-body">{}</div></main>'])
def test_comments_in_other_layouts(model, main, comments):
    body = "<h1>A day out</h1><p>We went to the lake in the morning, before anyone else was there.</p><p>It was cold. We stayed.</p>"
    said = "<div><b>Kim</b><p>Where is that lake? I would like to go there too.</p></div>"
    page = f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav>{main.format(body)}{comments.format(said)}<footer>Imprint</footer></body>"
    assert htmltext.main_text(page, model)[0] == "A day out We went to the lake in the morning, before anyone else was there. It was cold. We stayed."


def test_svg_noscript_and_objects_are_read():
    text = lambda p: [b.text for b in htmltext.blocks(p)]
    assert text("<p>a <svg><text>b</text></svg> c</p><noscript><p>d</p></noscript><object>e</object><script>f</script>") == ["a b c", "d", "e"]
    assert text("<p title='x>y'>a") == ["a"] and text("<p title=it's>b") == ["b"]
    assert text("<p>a &#99999999999999999999; b &amp; c</p>") == ["a � b & c"]


BROKEN = {
    "quotes": "<a " * 330_000 + '"',
    "quoted": "<p title='x \"y>" * 60_000,
    "nested": "<div>x" * 150_000,
    "scopes": "<li><ul>" + "<div>" * 80_000 + "<li></li>" * 40_000,
    "options": "<div>" * 80_000 + "<option></option>" * 40_000,
    "names": "".join(f'<div class="n{k} comment">x' for k in range(40_000)),
    "closers": "<b>" * 100_000 + "</i>" * 100_000,
    "paragraphs": "<p>" * 300_000,
    "less": "<" * 1_000_000,
    "comments": "<!-- x " * 140_000,
    "digits": "&#" + "1" * 1_000_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_a_megabyte_of_broken_markup_takes_seconds(model, name):
    began = time.process_time()
    htmltext.main_text(BROKEN[name], model)
    assert time.process_time() - began < 8


@pytest.mark.parametrize("name", PAGES)
def test_pages_written_by_hand(model, name):
    page, text = PAGES[name]
    assert htmltext.main_text(page, model)[0] == text


def test_optional_tags_make_the_same_blocks():
    """A page without any tag that HTML lets one leave out, against the same page with all of them."""
    bare = PAGES["no optional tag at all"][0]
    full = (
        bare.replace("<title>", "<html><head><title>").replace("<nav>", "</head><body><nav>").replace("<li><a href=/a>About</a></ul>", "</li><li><a href=/a>About</a></li></ul>")
        .replace("<p>They", "</p><p>They").replace("<ul><li>Some freeze<li>Some do not</ul>", "</p><ul><li>Some freeze</li><li>Some do not</li></ul>")
        .replace("<colgroup><col><col>", "<colgroup><col><col></colgroup>").replace("<tr><th>Lake<th>Metres", "<tr><th>Lake</th><th>Metres</th></tr></thead>")
        .replace("<tr><td>Baikal<td>1642<tr><td>Tanganyika<td>1470", "<tr><td>Baikal</td><td>1642</td></tr><tr><td>Tanganyika</td><td>1470</td></tr></tbody>")
        .replace("<tr><td>Mean<td>1556", "<tr><td>Mean</td><td>1556</td></tr></tfoot>").replace("<dt>Loch", "</dd><dt>Loch").replace("<dd>", "</dt><dd>").replace("lakes.</main>", "lakes.</p></main>") + "</footer></body></html>"
    )
    shape = lambda page: [(b.text, b.own, b.tags - {"html", "body"}, b.names) for b in htmltext.blocks(page)]
    assert shape(bare) == shape(full) and len(shape(bare)) == 22
