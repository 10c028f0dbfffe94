"""Trains the block labeller of html_text on generated pages: python -m quillspark.llm.train_html_text"""

from __future__ import annotations

import html
import random
import sys

import numpy as np

from . import html_text

SYLLABLES = "an the re tion er in es on ou la de que en ar st nt ed th mi ra los ver ein sch ie che ung au eau pre ment ka lo vi to su".split()
#: What an article stands in: known marks, made-up ones, none, a table's cell, or the body alone.
HOLDERS = "article article main known known known made bare bare cell body".split()
LABELS = "Home,News,About,Contact,Login,Search,Archive,Products,Blog,Shop,Help,Next,Previous,Tags,Share,RSS,Privacy,Terms".split(",")


def word(r: random.Random) -> str:
    return "".join(r.choices(SYLLABLES, k=r.choice([1, 1, 2, 2, 3])))


def sentence(r: random.Random, low: int = 3, high: int = 18) -> str:
    s = " ".join(word(r) for _ in range(r.randint(low, high)))
    return (s[0].upper() + s[1:]) + r.choice([".", ".", ".", "!", "?", ""])


def text(r: random.Random, low: int = 1, high: int = 6) -> str:
    if r.random() < 0.06:  # lists set with bars
        return " | ".join(word(r) for _ in range(r.randint(4, 40)))
    return " ".join(sentence(r) for _ in range(r.randint(low, high)))


def tag(r: random.Random, name: str, marks: list[str], share: float = 0.8) -> str:
    return f"{name} {r.choice(['class', 'id', 'class', 'role'])}=\"{r.choice(marks)}\"" if marks and r.random() < share else name


def laid(r: random.Random) -> list[tuple[str, bool | None]]:
    """A page as pieces (markup or text, label); label None for markup. One in fifteen is prose alone, with or without paragraphs."""
    if r.random() < 0.07:
        kind = r.choice(["p", "p", ""])
        top = r.choice(["<html><body>", "<body>", ""])
        body = [(f"<{kind}>" if kind else "", None) if i % 2 == 0 else (html.escape(text(r, 2, 30)), True) for i in range(2 * (r.randint(1, 4) if kind else 1))]
        return [(top, None), *body]
    out: list[tuple[str, bool | None]] = []
    m = lambda x: out.append((x, None))
    say = lambda x, main: out.append((html.escape(x, quote=r.random() < 0.5), main))

    def links(n: int) -> None:
        m("<ul>" if r.random() < 0.7 else "<div>")
        kind = "li" if out[-1][0] == "<ul>" else r.choice(["p", "span", "div"])
        for _ in range(n):
            m(f'<{kind}><a href="/x">')
            say(r.choice([r.choice(LABELS), word(r), sentence(r, 2, 8)]), False)
            m(f"</a></{kind}>" if r.random() < 0.9 else "</a>")
        m("</ul>" if kind == "li" else "</div>")

    def small(main: bool, low: int = 1, high: int = 3) -> None:
        kind = r.choice(["p", "div", "span", "p", ""])
        m(f"<{kind}>" if kind else "")
        say(text(r, low, high), main)
        m(f"</{kind}>" if kind else "")

    def side(kind: str) -> None:
        name, marks = {
            "nav": (r.choice(["nav", "nav", "div", "ul"]), ["menu", "nav", "navigation", "breadcrumbs", "navbar", "topnav"]),
            "header": (r.choice(["header", "header", "div"]), ["header", "masthead", "site-header", "banner", "top"]),
            "footer": (r.choice(["footer", "footer", "div"]), ["footer", "site-footer", "copyright", "bottom", "contentinfo"]),
            "aside": (r.choice(["aside", "aside", "div"]), ["sidebar", "related", "widget", "side", "complementary", "popular"]),
            "notice": (r.choice(["div", "div", "section"]), ["cookie", "cookie-banner", "notice", "consent", "newsletter", "popup", "modal", "alert", "subscribe"]),
            "ad": (r.choice(["div", "div", "section", "aside"]), ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner-ad"]),
            "form": ("form", ["search", "login", "signup", "comment-form"]),
            "comments": (r.choice(["section", "div", "ol"]), ["comments", "comment-list", "responses", "discussion", "replies"]),
        }[kind]
        sure = kind in ("ad", "notice", "comments") or name in ("div", "ul", "section", "ol")
        m(f"<{tag(r, name, marks, 1.0 if sure else 0.4)}>")
        if kind in ("nav", "header"):
            if kind == "header":
                m("<h1>" if r.random() < 0.3 else "<div>")
                say(sentence(r, 1, 4), False)
                m("</h1>" if out[-2][0] == "<h1>" else "</div>")
            links(r.randint(2, 9))
        elif kind == "comments":
            if r.random() < 0.6:
                m("<h3>")
                say(r.choice(["Comments", "Responses", sentence(r, 1, 3)]), False)
                m("</h3>")
            for _ in range(r.randint(1, 7)):
                m(f"<{tag(r, 'div', ['comment', 'comment-body', 'reply'], 0.7)}>")
                if r.random() < 0.5:
                    small(False, 1, 1)
                m("<p>")
                say(text(r, 1, 5), False)
                m("</p></div>")
        elif kind == "form":
            m('<label>')
            say(sentence(r, 1, 4), False)
            m('</label><input type="text"><button>')
            say(word(r), False)
            m("</button>")
        else:
            if r.random() < 0.4:
                m("<h3>")
                say(sentence(r, 1, 4), False)
                m("</h3>")
            for _ in range(r.randint(1, 3)):
                small(False, 1, 4)
            if kind in ("aside", "footer") and r.random() < 0.6:
                links(r.randint(2, 6))
        m(f"</{name}>" if r.random() < 0.97 else "")

    m("<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    before = [k for k in ("header", "nav", "notice", "form", "ad", "aside") if r.random() < (0.75 if k == "nav" else 0.35)]
    r.shuffle(before)
    for k in before:
        side(k)
    kind = r.choice(HOLDERS)
    holder = kind if kind in ("article", "main") else {"cell": "td", "body": ""}.get(kind) or ("" if kind == "body" else r.choice(["div", "div", "section"]))
    marks = {"article": 0.3, "main": 0.3, "known": 1.0}.get(kind, 0)
    wrap = kind != "body" and r.random() < 0.3
    if wrap:
        m(f"<{tag(r, r.choice(['div', 'main']), ['container', 'wrapper', 'page', 'layout', 'content'])}>")
    if kind == "cell":
        m("<table><tr>")
        if r.random() < 0.4:
            m("<td>")
            links(r.randint(2, 6))
            m("</td>")
    inner = r.choice([0, 0, 0, 1, 2]) if kind == "bare" else 0
    m("<div>" * inner)
    made = [f"{word(r)}-{r.choice(['body', 'text', word(r)])}", word(r)]
    if holder:
        m(f"<{tag(r, holder, made if kind == 'made' else ['content', 'post', 'entry-content', 'article-body', 'story', 'main-content', 'text'], 1.0 if kind == 'made' else marks)}>")
    if r.random() < 0.9:
        h = r.choice(["h1", "h1", "h2"])
        m(f"<{h}>")
        say(sentence(r, 1, 12), True)
        m(f"</{h}>")
    for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12, 20])):
        x = r.random()
        if x < 0.08:
            m("<h2>")
            say(sentence(r, 1, 6), True)
            m("</h2>")
        elif x < 0.14:
            m("<ul>")
            for _ in range(r.randint(1, 6)):
                m("<li>")
                say(sentence(r, 2, 14), True)
                m("</li>")
            m("</ul>")
        elif x < 0.18:
            m("<blockquote>")
            say(text(r, 1, 3), True)
            m("</blockquote>")
        elif x < 0.24:
            side(r.choice(["ad", "ad", "aside", "notice"]))
        elif x < 0.28:
            m("<table><tr><td>")
            say(sentence(r, 1, 4), True)
            m("</td><td>")
            say(sentence(r, 1, 4), True)
            m("</td></tr></table>")
        else:
            m("<p>" if r.random() < 0.9 else "<div>")
            if r.random() < 0.15:
                m("<b>")
            say(r.choice([text(r), text(r), sentence(r, 1, 3)]), True)
            if r.random() < 0.15:
                m("<br>")
            m("</p>" if r.random() < 0.8 else "")
    m(f"</{holder}>" if holder else "")
    m("</div>" * inner)
    m("</tr></table>" if kind == "cell" else "")
    if wrap:
        m("</div>" if r.random() < 0.9 else "")
    after = [k for k in ("comments", "aside", "ad", "form", "notice", "nav") if r.random() < 0.3]
    r.shuffle(after)
    for k in after:
        side(k)
    if r.random() < 0.85:
        side("footer")
    if r.random() < 0.9:
        m("</body></html>")
    return out


#: A mark around generated texts that block texts keep: the label of the block.
YES, NO = "\ue000", "\ue001"


def sample(seed: int) -> tuple[str, list[bool]]:
    """(page, label of each block)."""
    r = random.Random(seed)
    pieces = laid(r)
    marked = "".join(p if y is None else (YES if y else NO) + p for p, y in pieces)
    labels = [YES in b.text for b in html_text.blocks(marked)]
    return "".join(p for p, _ in pieces), labels


def dataset(seeds: range, drop: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    xs, ys = [], []
    for seed in seeds:
        page, labels = sample(seed)
        found = html_text.blocks(page)
        if found and len(found) == len(labels):
            x = html_text.vectors(found)
            if drop:
                # half of the pages have other words: shape, path and neighbours have to do
                words = slice(html_text.PATH, html_text.PATH + html_text.TEXT)
                x[:, words] = x[:, words] if seed % 2 else np.random.default_rng(seed).permutation(x[:, words].ravel()).reshape(len(x), -1)
            xs.append(x)
            ys.append(np.array(labels, np.float32))
    return xs, ys


def accuracy(w: dict, xs: list, ys: list) -> float:
    got = [s for i in range(0, len(xs), 64) for s in html_text.scores(w, xs[i : i + 64])]
    return float(np.mean(np.concatenate([(g > html_text.LEAST) == (y > 0) for g, y in zip(got, ys, strict=True)])))


def main(to: str) -> None:
    w = html_text.train(*dataset(range(9000), drop=True), steps=1800)
    print("held-out accuracy", accuracy(w, *dataset(range(100_000, 101_000))))
    np.savez_compressed(to, **{k: v.astype(np.float32) for k, v in w.items()})


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else str(html_text.WEIGHTS))
