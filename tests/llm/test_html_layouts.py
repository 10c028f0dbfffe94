"""Articles of layouts with and without marks, skipped elements inside lines, and pages that nest without end."""

import time

import pytest

from quillspark.llm import html_text

PROSE = [
    "The harbour was quiet when the ferry came in, and nobody on the quay seemed to expect it.",
    "She had been told that the office would open at nine, but the door stayed shut until noon.",
    "Prices rose again in spring, the third time in a year, and several shops closed for good.",
    "A survey of the river found fewer fish than before, which surprised the people who had run it.",
    "They walked back along the canal, talking about the film and whether it had been worth the wait.",
    "In the end the council agreed to keep the library, though with shorter hours and less staff.",
]
NAV = '<div class="nav"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></div>'
FOOT = '<div class="footer">Copyright 2024 Example Press. All rights reserved.</div>'
LAYOUTS = {
    "article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "section": ("<section>", "</section>"), "content": ('<div id="content">', "</div>"), "entry": ('<div class="entry-content">', "</div>"), "story": ('<div class="story">', "</div>"),
    "body": ("", ""), "cell": ("<table><tr><td>", "</td></tr></table>"), "post-body": ('<div class="post-body">', "</div>"), "bare": ("<div>", "</div>"), "nested": ("<div><div><div>", "</div></div></div>"),
}


def extracted(page):
    return html_text.extract_pages([page], html_text.weights())[0].split("\n")


@pytest.mark.parametrize("name", LAYOUTS)
def test_every_paragraph_is_found(name):
    a, b = LAYOUTS[name]
    page = f"<html><body>{NAV}{a}<h1>A quiet morning</h1>{''.join(f'<p>{p}</p>' for p in PROSE)}{b}{FOOT}</body></html>"
    assert extracted(page) == ["A quiet morning", *PROSE]


def test_prose_alone():
    one, other = " ".join(PROSE[:3]), " ".join(PROSE[3:])
    assert extracted(f"<body><p>{one}</p><p>{other}</p></body>") == [one, other]
    assert extracted(" ".join(PROSE)) == [" ".join(PROSE)]


def test_skipped_elements_do_not_part_a_line():
    read = lambda page: [b.text for b in html_text.blocks(page)]
    assert read("<p>x <svg><path/></svg> y</p><p>before <select><option>a</select> after<script>z</script></p>q") == ["x y", "before after", "q"]
    assert read("<p>a <svg> b <svg> c") == ["a b c"]


def test_the_stack_closes_as_before():
    read = lambda page: [(b.text, b.place.entry if b.place else "") for b in html_text.blocks(page)]
    assert read("<p>a<p>b<div>c</p>d</div>e") == [("a", "p"), ("b", "p"), ("c", "div"), ("d", "div"), ("e", "")]
    assert read("<ul><li>a<ul><li>b</ul>c<li>d</ul>") == [("a", "li"), ("b", "li"), ("c", "li"), ("d", "li")]
    assert read("<table><tr><td>a<td>b<p>c<tr><td>d</table>e") == [("a", "td"), ("b", "td"), ("c", "p"), ("d", "td"), ("e", "")]
    assert read("<span><div>a</span>b</div>c") == [("ab", "div"), ("c", "")]


@pytest.mark.parametrize("page", ["<div>x", "<svg>x", "<p>x<select>", "<b>y", "<x><div>y</x>"])
def test_time_grows_as_the_page(page):
    took = []
    for n in (10_000, 40_000):
        t = time.process_time()
        html_text.blocks(page * n + "</i>z" * n)
        took.append(time.process_time() - t)
    assert took[1] < 8 * took[0] + 0.5
