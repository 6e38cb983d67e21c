"""Elements are hidden by the names of their attributes, not by words within values."""

import pytest

from terrane.llm import htmltext


@pytest.mark.parametrize("tag", ['a title="A hidden gem"', 'article title="the hidden cost of x"', 'p class="card hidden md"', "p title='display: none'"])
def test_words_within_values_hide_nothing(tag):
    assert [b.text for b in htmltext.blocks(f"<body><{tag}>Some text</{tag.split()[0]}></body>")] == ["Some text"]


@pytest.mark.parametrize("tag", ["p hidden", 'p HIDDEN=""', 'p id="a" hidden class="b"', 'p style="color: red; display: none"', "p style=display:none"])
def test_attributes_hide(tag):
    assert not htmltext.blocks(f"<body><{tag}>Some text</p></body>")


def test_what_screen_readers_pass_over_is_shown():
    [block] = htmltext.blocks('<p aria-hidden="true">Some text</p>')
    assert block.text == "Some text" and "ariahidden" in block.names
