"""Labelled web pages for the training of the main-text model.

No table has labelled pages, so pages are made from layouts of common kinds: semantic tags, class and id names, or
neither; menus, headers, footers, sidebars, notices, adverts, forms and reader comments around the article and inside
it. ``data-y`` marks where the main text begins (``in``) and where something else stands inside it (``out``); the
features don't see it. A page depends on its number alone.
"""

from __future__ import annotations

import html
import random

# Names that pages give to their parts.
CONTENT = ("article", "content", "post", "post-content", "entry-content", "story", "story-body", "main", "main-content",
           "article-body", "articleBody", "text", "blog-post", "single-entry")
MENU = ("nav", "menu", "main-menu", "navbar", "navigation", "breadcrumb", "topnav", "pagination", "toc")
HEADER = ("header", "masthead", "site-header", "top", "page-head", "logo-bar")
FOOTER = ("footer", "site-footer", "bottom", "colophon", "copyright", "legal")
SIDE = ("sidebar", "side", "widget", "related", "recommended", "teaser-list", "popular", "trending", "right-rail widget")
ADVERT = ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "adsbygoogle", "banner-ad")
COMMENT = ("comments", "commentlist", "comment-section", "disqus_thread", "replies", "respond", "discussion")
NOTICE = ("cookie-notice", "notice", "consent", "gdpr-banner", "alert", "popup", "modal", "newsletter", "disclaimer")
SHARE = ("share", "social", "share-bar", "byline", "post-meta", "tags", "toolbar", "author-box")
FORM = ("search", "search-form", "login", "contact-form", "subscribe", "signup-form", "poll")
NOISE = ("col-8", "row", "wrap", "css-1x2y", "block", "inner", "grid", "clearfix", "module", "u-mt", "outer", "box")

_SYLLABLES = ("an", "be", "cor", "de", "el", "fra", "gi", "ha", "is", "jo", "ka", "lu", "mé", "no", "or", "pe", "qua",
              "ri", "ßen", "ta", "ur", "ven", "wo", "xi", "yl", "zu", "th", "ion", "ó", "eau")


class PageMaker:
    def __init__(self, number: int):
        self.rng = rng = random.Random(number)
        self.naming = rng.choices(("semantic", "named", "both", "bare"), (35, 35, 20, 10))[0]
        self.junk = rng.random() < 0.1

    # Text and markup

    def word(self) -> str:
        word = "".join(self.rng.choices(_SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3, 4))))
        return word + self.rng.choice(("", "###", "***", "%%%", "&&&", "$")) if self.junk else word

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(2, 18)
        return text[0].upper() + text[1:] + self.rng.choice((".", ".", ".", "!", "?", ", ", ""))

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def inline(self, text: str) -> str:
        """Escaped text, some of its words marked up."""
        words = html.escape(text, quote=False).split(" ")
        for _ in range(self.rng.choice((0, 0, 1, 2))):
            i = self.rng.randrange(len(words))
            tag = self.rng.choice(('b', 'em', 'a href="/x"', 'span', 'span class="hl"', 'code', 'i'))
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
        return " ".join(words)

    def named(self, tag: str, names: tuple[str, ...], mark: str = "") -> tuple[str, str]:
        """Start and end tag of a part: the semantic tag, a named ``div``, both, or a bare ``div``."""
        naming = self.naming if tag in ("article", "main", "nav", "header", "footer", "aside", "form") else (
            "bare" if self.naming == "bare" else "named")
        name = self.rng.choice(names)
        attribute = self.rng.choice((f'class="{name}"', f'id="{name}"', f'class="{self.rng.choice(NOISE)} {name}"'))
        own = tag if naming in ("semantic", "both") or tag == "form" else self.rng.choice(("div", "div", "section"))
        if naming in ("semantic", "bare"):
            attribute = self.rng.choice(("", "", f'class="{self.rng.choice(NOISE)}"'))
        return f"<{own} {attribute}{mark}>", f"</{own}>"

    def links(self, low: int, high: int) -> list[str]:
        return [f'<a href="/{i}">{html.escape(self.words(1, 3))}</a>' for i in range(self.rng.randint(low, high))]

    # Parts that are no main text

    def menu(self, out: str = "") -> str:
        start, end = self.named("nav", MENU, out)
        if self.rng.random() < 0.7:
            return f"{start}<ul>{''.join(f'<li>{link}</li>' for link in self.links(3, 12))}</ul>{end}"
        return start + self.rng.choice((" | ", " ", " &raquo; ")).join(self.links(3, 12)) + end

    def header(self) -> str:
        start, end = self.named("header", HEADER)
        title = self.rng.choice(("h1", "div", "p", "h2"))
        extra = self.rng.choice(("", f"<p>{html.escape(self.sentence())}</p>", self.form(), self.menu()))
        return f"{start}<{title}><a href='/'>{html.escape(self.words(1, 3))}</a></{title}>{extra}{end}"

    def footer(self) -> str:
        start, end = self.named("footer", FOOTER)
        text = html.escape(self.prose(1, 3))
        said = f"&copy; {self.words(1, 2)} &middot; {text}" if self.rng.random() < 0.7 else f"<p>{text}</p>"
        return start + said + self.rng.choice(("", " ".join(self.links(2, 6)))) + end

    def side(self, out: str = "") -> str:
        start, end = self.named("aside", SIDE, out)
        parts = [f"<h3>{html.escape(self.words(1, 4))}</h3>"] if self.rng.random() < 0.7 else []
        if self.naming == "bare" or self.rng.random() < 0.6:
            parts.append(f"<ul>{''.join(f'<li>{link}</li>' for link in self.links(2, 8))}</ul>")
        else:
            parts += [f"<p>{html.escape(self.prose(1, 3))}</p>" for _ in range(self.rng.randint(1, 3))]
        return start + "".join(parts) + end

    def short(self, names: tuple[str, ...], out: str = "", tag: str = "div") -> str:
        start, end = self.named(tag, names, out)
        most = 1 if self.naming == "bare" else 4
        text = html.escape(self.prose(1, most))
        body = self.rng.choice((text, text, f"<p>{text}</p>", f"{text} <a href='/y'>{html.escape(self.words(1, 2))}</a>"))
        return start + body + self.rng.choice(("", "", "<button>OK</button>")) + end

    def form(self, out: str = "") -> str:
        start, end = self.named("form", FORM, out)
        fields = "".join(f"<label>{html.escape(self.words(1, 3))}</label><input name=a>" for _ in range(self.rng.randint(1, 4)))
        said = f"<p>{html.escape(self.prose(1, 2))}</p>" if self.rng.random() < 0.5 else ""
        return start + said + fields + "<textarea>x y</textarea><select><option>One<option>Two</select><button>Go</button>" + end

    def comments(self, out: str = "") -> str:
        start, end = self.named("div", COMMENT, out)
        if self.naming == "bare":
            start = start.replace("<div", '<div id="comments"').replace("<section", '<section id="comments"')
        each = self.rng.choice(("div", "li", "article")) if self.naming != "bare" else "div"
        posts = "".join(
            f'<{each} class="comment"><p class="author">{html.escape(self.words(1, 2))}</p><p>{html.escape(self.prose(1, 6))}</p></{each}>'
            if self.rng.random() < 0.6 else f"<p>{html.escape(self.prose(1, 6))}</p>"
            for _ in range(self.rng.randint(1, 5)))
        return f"{start}<h3>{html.escape(self.words(1, 3))}</h3>{posts}{self.rng.choice(('', self.form()))}{end}"

    def other(self, out: str = "") -> str:
        return self.rng.choice((
            lambda: self.short(ADVERT, out), lambda: self.short(NOTICE, out), lambda: self.side(out),
            lambda: self.short(SHARE, out) if self.rng.random() < 0.5 else self.menu(out), lambda: self.form(out),
        ))()

    # The article

    def block(self) -> tuple[str, str]:
        """One block of the article and its text."""
        kind = self.rng.choices(("p", "div", "h2", "ul", "quote", "table", "pre"), (70, 8, 8, 6, 4, 2, 2))[0]
        if kind == "ul":
            items = [self.words(1, 12) for _ in range(self.rng.randint(1, 5))]
            close = self.rng.choice(("</li>", ""))
            return f"<ul>{''.join(f'<li>{self.inline(i)}{close}' for i in items)}</ul>", " ".join(items)
        if kind == "table":
            cells = [self.words(1, 3) for _ in range(4)]
            rows = "".join(f"<tr><td>{html.escape(a)}<td>{html.escape(b)}" for a, b in zip(cells[::2], cells[1::2], strict=True))
            return f"<table>{rows}</table>", " ".join(cells)
        text = self.words(1, 8) if kind == "h2" else self.prose(1, self.rng.choice((1, 3, 8)))
        if kind == "p":
            tags = self.rng.choice((("<p>", "</p>"), ("<p>", "</p>"), ("<p>", ""), ("<p><b>", "<br>"), ("<p class='t1'>", "</p>")))
        else:
            tags = {"div": ("<div>", "</div>"), "h2": ("<h2>", "</h2>"), "quote": ("<blockquote><p>", "</p></blockquote>"),
                    "pre": ("<pre>", "</pre>")}[kind]
        return tags[0] + self.inline(text) + tags[1], text

    def article(self) -> tuple[str, str]:
        rng = self.rng
        title = self.words(1, 12)
        tag = rng.choice(("h1", "h1", "h1", "h2"))
        head = f"<{tag}>{html.escape(title)}</{tag}>"
        parts, texts = [rng.choice((head, head, f"<header>{head}</header>"))], [title]
        if rng.random() < 0.1:
            parts, texts = [], []
        if rng.random() < 0.2:
            parts.append(self.short(SHARE, ' data-y="out"'))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 20)) if texts else rng.randint(1, 8)):
            part, text = self.block()
            parts.append(part)
            texts.append(text)
            if rng.random() < 0.08:
                parts.append(self.other(' data-y="out"'))
        if rng.random() < 0.2:
            parts.append(self.comments(' data-y="out"'))
        start, end = self.named(rng.choice(("article", "article", "main")), CONTENT, ' data-y="in"')
        if self.naming == "bare" and rng.random() < 0.3:
            start, end = '<table><tr><td data-y="in">', "</table>"
        return start + rng.choice(("", "\n")).join(parts) + end, " ".join(" ".join(texts).split())

    def page(self) -> tuple[str, str]:
        """The page and its main text."""
        rng = self.rng
        article, text = self.article()
        around = [article]
        for chance, make in ((0.4, self.side), (0.3, self.comments), (0.3, self.other)):
            if rng.random() < chance:
                around.append(make())
        for chance, make in ((0.3, self.side), (0.4, self.other), (0.3, lambda: self.short(ADVERT))):
            if rng.random() < chance:
                around.insert(0, make())
        body = "".join(around)
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            body = f'<div {rng.choice(("class", "id"))}="{rng.choice((*NOISE, "page", "container"))}">{body}</div>'
        before = [p for chance, make in ((0.5, self.header), (0.7, self.menu), (0.3, lambda: self.short(NOTICE)),
                                         (0.4, lambda: self.short(ADVERT))) if rng.random() < chance for p in [make()]]
        after = [p for chance, make in ((0.8, self.footer), (0.15, lambda: self.short(NOTICE))) if rng.random() < chance
                 for p in [make()]]
        title = html.escape(self.words(1, 8))
        head = f"<head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        end = rng.choice(("</body></html>", ""))
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- x -->{body}{''.join(after)}{end}", text
