"""Labelled pages for training: random layouts around random text, each block's label known as it is written."""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

_SYLLABLES = "an be ca do el fi ga ho in jo ka lu me no or pa qui ra so ti un ve wa xe yo za é ü ñ".split()

#: Wrappers of main text: tag and class.
_MAIN = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post-content"), ("div", "entry-content"), ("section", "article-body"), ("div", "story"), ("article", "entry hentry"), ("div", "main-text")]
#: Wrappers of everything else, by kind: tag and class.
_REST = {
    "menu": [("nav", ""), ("nav", "menu"), ("div", "menu"), ("div", "navbar"), ("ul", "nav-links"), ("div", "navigation"), ("div", "breadcrumb"), ("menu", "")],
    "header": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "topbar"), ("div", "banner")],
    "footer": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "bottom")],
    "sidebar": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("section", "recommended"), ("div", "side-column")],
    "notice": [("div", "cookie-notice"), ("div", "notice"), ("div", "alert"), ("div", "consent"), ("div", "cookie-banner"), ("section", "newsletter"), ("div", "popup modal"), ("div", "gdpr"), ("dialog", "")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("aside", "promo"), ("div", "ad-banner"), ("section", "sponsor")],
    "form": [("form", ""), ("form", "search"), ("div", "login form"), ("form", "subscribe"), ("form", "signup")],
    "comments": [("div", "comments"), ("section", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "disqus"), ("div", "reader-comments"), ("section", "responses discussion")],
    "share": [("div", "share"), ("div", "social"), ("div", "meta"), ("div", "byline"), ("div", "tags")],
}


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentence(rng: random.Random, low: int, high: int) -> str:
    style = rng.random()
    text = _words(rng, rng.randint(low, high))
    if style < 0.05:
        return text.upper() + "!!"
    if style < 0.1:
        return " | ".join(text.split(" "))
    if style < 0.15:
        return " ".join(w + rng.choice(["###", "%%%", "$$$", "&&&", "***"]) for w in text.split(" "))
    return text.capitalize() + rng.choice([".", ".", ".", "!", "?", ""])


def _paragraph(rng: random.Random) -> str:
    return " ".join(_sentence(rng, 1, 25) for _ in range(rng.choice([1, 1, 2, 4, 8])))


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, set()

    def text(self, text: str, main: bool) -> str:
        text = " ".join(text.split())
        if main:
            self.main.add(text)
        elif text in self.main:
            return ""
        return html.escape(text)

    def tag(self, tag: str, name: str, inner: str) -> str:
        key = self.rng.choice(["class", "class", "id"])
        return f'<{tag} {key}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def body(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            out.append(f"<h1>{self.text(_sentence(rng, 2, 12), True)}</h1>")
        for _ in range(rng.choice([1, 2, 3, 5, 9, 15])):
            kind = rng.random()
            if kind < 0.1:
                out.append(f"<h{rng.randint(2, 4)}>{self.text(_sentence(rng, 1, 7), True)}</h{rng.randint(2, 4)}>")
            elif kind < 0.18:
                out.append("<ul>" + "".join(f"<li>{self.text(_sentence(rng, 1, 12), True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.23:
                out.append(f"<blockquote>{self.text(_paragraph(rng), True)}</blockquote>")
            elif kind < 0.26:
                out.append("<table>" + "".join(f"<tr><td>{self.text(_words(rng, 2), True)}</td><td>{self.text(_words(rng, 3), True)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.3:
                out.append(f"<div>{self.text(_paragraph(rng), True)}</div>")
            elif kind < 0.4:
                out.append(f"<p><b>{self.text(_paragraph(rng), True)}<br>")
            else:
                out.append(f"<p>{self.text(_paragraph(rng), True)}{rng.choice(['</p>', '</p>', ''])}")
            if rng.random() < 0.08:
                out.append(self.rest(rng.choice(["advert", "share", "form", "notice", "sidebar"])))
        return "".join(out)

    def rest(self, kind: str) -> str:
        rng = self.rng
        tag, name = rng.choice(_REST[kind])
        items = rng.randint(1, 6)
        if kind == "menu" or (kind in ("header", "sidebar", "footer", "share") and rng.random() < 0.5):
            inner = "".join(f'<li><a href="/{k}">{self.text(_words(rng, rng.randint(1, 4)), False)}</a></li>' for k in range(items))
            inner = inner if tag in ("ul", "ol", "menu") else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f"<label>{self.text(_words(rng, 2), False)}</label><input name=q><button>{self.text(_words(rng, 1), False)}</button><p>{self.text(_sentence(rng, 2, 15), False)}</p>"
        elif kind == "comments":
            inner = "".join(f'<{x} class="comment"><p>{self.text(_paragraph(rng), False)}</p></{x}>' for x in [rng.choice(["div", "li", "article"])] * items)
        elif kind == "footer":
            inner = f"&copy; {self.text(_words(rng, 2), False)} &middot; {self.text(_sentence(rng, 2, 14), False)}"
        else:
            inner = "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "{}", "<h1>{}</h1>", "<h3>{}</h3>"]).format(self.text(_paragraph(rng), False)) for _ in range(rng.randint(1, 3)))
        return self.tag(tag, name, inner)

    def html(self) -> str:
        rng = self.rng
        before = [self.rest(k) for k in ("header", "menu", "notice", "advert", "sidebar", "form") if rng.random() < 0.45]
        after = [self.rest(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "footer", "menu") if rng.random() < 0.45]
        rng.shuffle(before)
        rng.shuffle(after)
        tag, name = rng.choice(_MAIN + _MAIN[:1] * 3)
        inside = self.body() + (self.rest("comments") if rng.random() < 0.15 else "")
        main = self.tag(tag, name, inside)
        if rng.random() < 0.3:
            main = self.tag("div", rng.choice(["wrapper", "container", "page", ""]), main + (after.pop() if after else ""))
        return f"<!DOCTYPE html><html><head><title>{self.text(_words(rng, 4), False)}</title><style>p{{}}</style></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """``(html, texts of the main blocks)`` of n generated pages."""
    for k in range(n):
        page = _Page(random.Random(seed * 1_000_003 + k))
        text = page.html()
        yield text, page.main
