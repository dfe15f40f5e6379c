"""Labelled pages for fitting the page model: page layouts of many kinds, drawn from a seed, whose blocks are known to be article or not."""

from __future__ import annotations

import random

# Names that sites give to the parts of a page.
ARTICLE_NAMES = ["content", "post", "entry", "entry-content", "article-body", "post-content", "story", "main-content", "text", "article", "body-text", "page-content"]
SIDE_NAMES = ["sidebar", "side", "aside", "widget", "related", "related-posts", "recommended", "more-stories", "popular", "tags", "archive", "right-column"]
AD_NAMES = ["ad", "ads", "advert", "advertisement", "banner-ad", "sponsored", "promo", "promotion", "ad-slot", "adsbox"]
NOTICE_NAMES = ["notice", "cookie-notice", "cookie-banner", "alert", "consent", "gdpr", "message", "newsletter", "subscribe", "popup", "modal", "paywall", "warning", "announcement", "disclaimer"]
COMMENT_NAMES = ["comments", "comment-list", "comment", "commentlist", "responses", "replies", "discussion", "reader-comments", "disqus_thread", "respond"]
NAV_NAMES = ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "pagination", "toc", "topbar", "main-menu", "navigation", "pager"]
HEAD_NAMES = ["header", "site-header", "masthead", "branding", "top", "banner", "page-header"]
FOOT_NAMES = ["footer", "site-footer", "copyright", "bottom", "colophon", "legal", "page-footer"]
SHARE_NAMES = ["share", "social", "share-buttons", "sharing", "follow-us", "author-box", "byline", "meta", "post-meta"]

SYLLABLES = ["ka", "lo", "mi", "ru", "se", "ta", "vo", "ne", "ri", "sol", "tan", "ub", "wex", "é", "ü", "th", "er", "ing"]


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.truth = rng, [], []
        self.good = False
        self.brief = rng.random() < 0.2  # pages of many short paragraphs, such as verse
        self.stop = rng.choice([".", ".", ".", "", "!!", " |", "...", ","])  # how this page ends its sentences

    def sentence(self, low: int, high: int) -> str:
        r = self.rng
        words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text = " ".join(words)
        return text[:1].upper() + text[1:]

    def prose(self, sentences: int) -> str:
        return " ".join(self.sentence(1, self.rng.choice([4, 18, 18, 60])) + self.stop for _ in range(sentences))

    def element(self, tag: str, inside, name: str = "", attr: str = "class", close: bool = True) -> None:
        label = f' {attr}="{name}"' if name else ""
        self.out.append(f'<{tag}{label} data-y="{int(self.good)}">')
        inside() if callable(inside) else self.out.append(inside)
        if close:
            self.out.append(f"</{tag}>")

    def inline(self, text: str) -> str:
        r = self.rng
        words = text.split(" ")
        if r.random() < 0.3 and len(words) > 4:
            k = r.randrange(len(words) - 2)
            tag = r.choice(["b", "i", "em", "strong", "span", "code", 'a href="/x"', "cite", "q"])
            words[k : k + 2] = [f"<{tag}>{words[k]} {words[k + 1]}</{tag.split()[0]}>"]
        return " ".join(words)

    def paragraph(self, sentences: int) -> None:
        if self.brief and self.good and self.rng.random() < 0.9:
            text, odd = self.sentence(1, 4) + self.stop, self.rng.random()
        else:
            text, odd = self.inline(self.prose(sentences)), self.rng.random()
        if odd < 0.1:
            self.out.append(f'<p data-y="{int(self.good)}"><b>{text}<br>')
        else:
            self.element("p", text, close=odd < 0.85)

    def links(self, n: int, tag: str = "ul", name: str = "") -> None:
        def items():
            for _ in range(n):
                self.element("li", f'<a href="/x">{self.sentence(1, 4)}</a>')

        self.element(tag, items, name)


def _name(r: random.Random, names: list[str]) -> tuple[str, str]:
    return r.choice(names) + ("" if r.random() < 0.8 else f" {r.choice(['col', 'box', 'block', 'clearfix', 'wrap'])}"), "id" if r.random() < 0.25 else "class"


def labelled_page(seed: int) -> str:
    """Html of a page whose elements carry data-y: 1 for article text, 0 for everything else."""
    r = random.Random(seed)
    w = _Writer(r)

    def bad(f):
        def run(*a, **b):
            before, w.good = w.good, False
            f(*a, **b)
            w.good = before

        return run

    @bad
    def nav():
        if r.random() < 0.6:
            w.element("nav", lambda: w.links(r.randint(3, 8)), r.choice(["", "", r.choice(NAV_NAMES)]))
        else:
            w.element("div", lambda: w.links(r.randint(3, 8)), *_name(r, NAV_NAMES))

    @bad
    def header():
        def inside():
            if r.random() < 0.6:
                w.element(r.choice(["h1", "h2", "p", "div"]), w.sentence(1, 5))
            if r.random() < 0.5:
                nav()
            if r.random() < 0.4:
                w.element("p", w.sentence(3, 10))

        w.element("header", inside) if r.random() < 0.5 else w.element("div", inside, *_name(r, HEAD_NAMES))

    @bad
    def ad():
        def inside():
            if r.random() < 0.5:
                w.out.append(w.prose(r.randint(1, 3)))
            else:
                w.element("p", w.prose(r.randint(1, 3)))

        w.element(r.choice(["div", "div", "aside", "section"]), inside, *_name(r, AD_NAMES))

    @bad
    def notice():
        def inside():
            if r.random() < 0.3:
                w.element("h3", w.sentence(2, 5))
            if r.random() < 0.3:
                w.out.append(w.prose(r.randint(1, 2)))
            else:
                w.element("p", w.prose(r.randint(1, 3)))
            if r.random() < 0.4:
                w.element("button", w.sentence(1, 2))

        tag = r.choice(["div", "div", "section", "p"])
        w.element(tag, inside if tag != "p" and r.random() < 0.8 else w.prose(1), *_name(r, NOTICE_NAMES))

    @bad
    def form():
        def inside():
            w.element("label", w.sentence(1, 3))
            w.out.append('<input type="text" name="q">')
            if r.random() < 0.5:
                w.element("p", w.prose(1))
            w.element("button", w.sentence(1, 2))

        w.element("form", inside, r.choice(["", "search", "login", "subscribe", "contact"]))

    @bad
    def aside():
        def inside():
            for _ in range(r.randint(1, 3)):
                w.element("h3", w.sentence(1, 4))
                w.links(r.randint(2, 6)) if r.random() < 0.6 else w.paragraph(r.randint(1, 3))

        w.element("aside", inside, r.choice(["", *SIDE_NAMES])) if r.random() < 0.5 else w.element(r.choice(["div", "section"]), inside, *_name(r, SIDE_NAMES))

    @bad
    def comments():
        def one():
            if r.random() < 0.6:
                w.element(r.choice(["span", "div", "h4"]), w.sentence(1, 2), r.choice(["author", "comment-author", "user"]))
            for _ in range(r.randint(1, 2)):
                w.paragraph(r.randint(1, 5))

        def inside():
            if r.random() < 0.6:
                w.element(r.choice(["h2", "h3"]), w.sentence(1, 3))
            listed = r.random() < 0.4
            for _ in range(r.randint(1, 5)):
                if listed:
                    w.element("li", one, r.choice(["", "comment"]))
                elif r.random() < 0.6:
                    w.element(r.choice(["div", "article"]), one, r.choice(["comment", "reply", "comment-body", ""]))
                else:
                    one()
            if r.random() < 0.4:
                form()

        w.element(r.choice(["div", "section", "ol", "ul"]), inside, *_name(r, COMMENT_NAMES))

    @bad
    def share():
        w.links(r.randint(2, 5), name=r.choice(SHARE_NAMES)) if r.random() < 0.6 else w.element("div", w.sentence(2, 6), *_name(r, SHARE_NAMES))

    @bad
    def footer():
        def inside():
            if r.random() < 0.5:
                w.out.append("&copy; " + w.sentence(3, 9) + ".")
            else:
                w.element("p", "&copy; " + w.prose(r.randint(1, 2)))
            if r.random() < 0.4:
                w.links(r.randint(2, 6))

        w.element("footer", inside) if r.random() < 0.6 else w.element("div", inside, *_name(r, FOOT_NAMES))

    def article():
        w.good = True

        def body():
            if r.random() < 0.8:
                w.element(r.choice(["h1", "h1", "h2"]), w.sentence(3, 10))
            if r.random() < 0.2:
                share()
            for _ in range(r.randint(1, r.choices([2, 9, 40, 400], [25, 45, 24, 6])[0])):
                x = r.random()
                if x < 0.68:
                    w.paragraph(r.randint(1, 7))
                elif x < 0.76:
                    w.element(r.choice(["h2", "h3"]), w.sentence(2, 7))
                elif x < 0.81:
                    w.element(r.choice(["ul", "ol"]), lambda: [w.element("li", w.sentence(3, 14)) for _ in range(r.randint(2, 5))])
                elif x < 0.85:
                    w.element("blockquote", lambda: w.paragraph(2) if r.random() < 0.5 else w.out.append(w.prose(2)))
                elif x < 0.87:
                    w.element("pre", w.sentence(5, 20))
                elif x < 0.89:
                    w.element("table", lambda: [w.element("tr", lambda: [w.element("td", w.sentence(1, 4)) for _ in range(3)]) for _ in range(2)])
                elif x < 0.92:
                    w.element("div", lambda: w.paragraph(3))
                elif x < 0.95:
                    ad()
                elif x < 0.97:
                    notice()
                elif x < 0.985:
                    aside()
                else:
                    form()
            if r.random() < 0.15:
                share()

        x = r.random()
        if x < 0.55:
            w.element("article", body, r.choice(["", "", *ARTICLE_NAMES]))
        elif x < 0.7:
            w.element("main", lambda: w.element("article", body) if r.random() < 0.5 else body())
        elif x < 0.75:
            w.element("section", body, *_name(r, ARTICLE_NAMES))
        else:
            w.element("div", body, *_name(r, ARTICLE_NAMES))
        w.good = False

    def page():
        before = [f for f, p in ((header, 0.5), (nav, 0.7), (notice, 0.3), (ad, 0.5), (form, 0.2)) if r.random() < p]
        after = [f for f, p in ((comments, 0.5), (share, 0.2), (ad, 0.4), (form, 0.2), (notice, 0.2)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(after)
        for f in before:
            f()
        if r.random() < 0.3:
            aside()

        def middle():
            article()
            for f in after:
                f()

        shell = r.random()
        if shell < 0.4:
            middle()
        else:
            w.element("div", middle, r.choice(["wrapper", "container", "page", "main", "layout", ""]), r.choice(["class", "id"]))
        if r.random() < 0.4:
            aside()
        if r.random() < 0.85:
            footer()

    w.element("body", page)
    return "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head>" + "".join(w.out) + "</html>"
