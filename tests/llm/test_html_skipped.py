"""Where skipped elements of a page end."""

import pytest

from corvane.llm import html


def text_of(page):
    return " ".join(t for _, t in sorted(r for n in html.nodes_of(html.parse(page)) for r in n.runs))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><body><p>one</p>", "one"),
        ("<html><head><title>T</title><script>a = '<p>no</p>'</script><p>one</p>", "one"),
        ("<head><meta charset=x><link rel=y>one <b>two</b>", "one two"),
        ("<head><title>T</title>\n<template><p>no</p></template>\n</head><body><p>one</p>", "one"),
        ("<head><noscript><p>no</p></noscript><style>p</style></head><p>one</p>", "one"),
        ("<head><template><p>no</p><body><p>one</p>", "one"),
        ("<article><p>one <svg viewBox='0 0 1 1'/> two</p><p>three</p></article>", "one two three"),
        ("<article><div>one <select><option>no</div><p>two</p></article>", "one two"),
        ("<article><p>one <object data=x>no</p><p>two</p></article>", "one two"),
        ("<article><div>one <button><div>no</div> no</div><p>two</p></article>", "one two"),
        ("<div>one <object><object>no</object> no</object> two</div>", "one two"),
        ("<div>one <svg><title>no</title><text>no</text></svg> two</div>", "one two"),
        ("<div>one <canvas><div>no<p>no</canvas> two</div>", "one two"),
    ],
)
def test_skipped_elements_end(page, text):
    assert text_of(page) == text
