"""Labelled pages for the main-text model, composed by rule from layouts, names and filler.

An element with the attribute MARK of value 1 is content and passes its label to what it holds;
the value 0 takes parts out again (an advert within the article). The attribute is no feature.
Layouts are of two kinds: composed ones, whose content has a known name, an invented one or
none, and bare ones, with little more on the page than the article.
"""

from __future__ import annotations

import random

CONTENT = (
    "article", "main", 'div class="content"', 'div id="content"', 'div class="post-content"', 'div class="entry-content"',
    'div class="article-body"', 'section class="story"', 'div class="post"', 'div id="main"', 'div class="text"', "div", 'div role="main"',
)
MENU = ("nav", 'div class="nav"', 'div class="menu"', 'ul class="menu"', 'div id="navigation"', 'nav class="navbar"', 'div class="breadcrumb"', 'div class="breadcrumbs"', 'div role="navigation"')
HEADER = ("header", 'div class="header"', 'div id="header"', 'header class="site-header"', 'div class="masthead"', 'div class="banner"')
FOOTER = ("footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"')
SIDE = ("aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="widget"', 'div class="related"', 'div class="widget"', 'section class="related-posts"', 'div class="recommended"')
NOTICE = ('div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div class="alert"', 'div class="gdpr consent"', 'div class="modal popup"', 'div class="cookie"', 'div class="newsletter"', 'div class="paywall"', "noscript", 'div role="alert"')
ADVERT = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="ad-top"', 'aside class="sponsored"', 'div class="promo"', 'ins class="adsbygoogle"', 'div class="ad-banner"', 'section class="sponsor"')
COMMENTS = ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="comment"', 'div class="discussion"', 'section id="respond"', 'div class="replies"', 'ul class="comment-thread"')
FORM = ("form", 'form class="search"', 'form id="subscribe"', 'div class="search-box"', 'form class="comment-form"')
SHARE = ('div class="share"', 'ul class="social"', 'div class="tags"', 'div class="meta"', 'div class="byline"', 'div class="social-share buttons"')
MARK = "data-main"
SYLLABLES = ("ka", "lo", "mer", "ti", "sun", "dra", "pel", "vo", "ni", "gar", "est", "ul", "bren", "sho", "fi", "ran", "too", "ex", "wim", "ja")


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        text, left = [], r.randint(low, high)
        while left > 0:
            n = min(left, r.randint(4, 14))
            sentence = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
            text.append(" ".join(sentence).capitalize() + r.choice((".", ".", ".", "!", "?", "")))
            left -= n
        style = r.random()
        out = " ".join(text)
        return out.upper() if style < 0.08 else out.replace(" ", " *** ", 5) if style < 0.14 else out

    def box(self, names: tuple, inner: str, gold: str = "") -> str:
        name = self.r.choice(names)
        return f"<{name}{gold}>{inner}</{name.split()[0]}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(low, high))]
        return f"<ul>{''.join(items)}</ul>" if self.r.random() < 0.7 else " ".join(items).replace("<li>", "").replace("</li>", "")

    def blurb(self) -> str:
        return self.r.choice((self.words(2, 25), f"<p>{self.words(4, 40)}</p>", f"<h3>{self.words(1, 3)}</h3>{self.links(2, 5)}", f"<p>{self.words(3, 12)}</p><a href='/y'>{self.words(1, 2)}</a>"))

    def body(self) -> str:
        r, out = self.r, []
        if r.random() < 0.7:
            out.append(f"<h1>{self.words(3, 9)}</h1>")
        for _ in range(r.randint(1, 7)):
            x = r.random()
            if x < 0.68:
                out.append(f"<p>{self.words(1, 90)}</p>")
            elif x < 0.74:
                out.append(f"<h2>{self.words(2, 6)}</h2>")
            elif x < 0.80:
                out.append("<ul>" + "".join(f"<li>{self.words(3, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.84:
                out.append(f"<blockquote><p>{self.words(8, 40)}</p></blockquote>")
            elif x < 0.87:
                out.append(f"<pre><code>{self.words(5, 20)}</code></pre>")
            elif x < 0.90:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.94:
                out.append(f"<p>{self.words(5, 20)} <a href='/z'>{self.words(1, 4)}</a> {self.words(5, 20)}</p>")
            else:
                out.append(self.box(ADVERT + SHARE + NOTICE, self.blurb(), ' data-main="0"'))
        return "".join(out)

    def comments(self) -> str:
        one = lambda: f'<div class="comment"><span class="author">{self.words(1, 2)}</span><p>{self.words(5, 60)}</p></div>'
        return f"<h3>{self.words(1, 2)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 4)))

    def invented(self) -> str:
        """A container whose name says nothing."""
        r = self.r
        word = "".join(r.choice(SYLLABLES) for _ in range(3))
        return r.choice(("div", "section", "main", "article", f'div class="{word}"', f'div id="{word}"', f'section class="{word} {word[::-1]}"', f'div class="{word}-{r.choice(("box", "wrap", "inner", "col"))}"'))

    def bare(self) -> str:
        """Little more than an article: paragraphs, perhaps a heading, in any container."""
        r = self.r
        body = f"<h1>{self.words(1, 12)}</h1>" if r.random() < 0.5 else ""
        body += self.body() if r.random() < 0.3 else "".join(f"<p>{self.words(*r.choice(((4, 15), (10, 40), (30, 130))))}</p>" for _ in range(r.choice((1, 1, 2, 3, 5, 10))))
        if r.random() < 0.3:
            body = f'<body data-main="1">{body}</body>'
        else:
            name = r.choice((self.invented(), r.choice(CONTENT)))
            body = f'<{name} data-main="1">{body}</{name.split()[0]}>'
            if r.random() < 0.4:
                body = f"<body>{self.box(MENU, self.links(3, 7)) if r.random() < 0.4 else ''}{body}{self.box(FOOTER, self.words(2, 12)) if r.random() < 0.4 else ''}</body>"
        return body if r.random() < 0.5 else f"<html><head><title>{self.words(2, 8)}</title></head>{body}</html>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.35:
            return self.bare()
        parts = []
        if r.random() < 0.5:
            parts.append(self.box(HEADER, r.choice((self.blurb(), self.box(MENU, self.links(3, 7))))))
        if r.random() < 0.8:
            parts.append(self.box(MENU, self.links(3, 8)))
        parts += [self.box(f, self.blurb()) for f in (NOTICE, ADVERT, SIDE, ADVERT) if r.random() < 0.45]
        content = self.box((self.invented(),) if r.random() < 0.4 else CONTENT, self.body(), ' data-main="1"')
        inner = [content]
        if r.random() < 0.4:
            inner.append(self.box(COMMENTS, self.comments()))
        if r.random() < 0.3:
            inner.append(self.box(FORM, f"<label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button>"))
        if r.random() < 0.3:
            inner.append(self.box(SIDE, self.blurb()))
        middle = "".join(inner)
        parts.append(f'<div class="{r.choice(("container", "wrapper", "page", "row"))}">{middle}</div>' if r.random() < 0.5 else middle)
        parts += [self.box(f, self.blurb()) for f in (SHARE, NOTICE) if r.random() < 0.25]
        if r.random() < 0.85:
            parts.append(self.box(FOOTER, r.choice((self.words(3, 25), self.blurb(), self.links(2, 6)))))
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{''.join(parts)}</body></html>"


def labelled_pages(n: int = 600, seed: int = 5) -> list[str]:
    return [_Page(seed * 100_003 + i).page() for i in range(n)]
