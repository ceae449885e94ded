"""Labelled pages to learn from: made layouts whose main text is known.

No table holds labelled pages, so they are made here from a seed: pages of invented words in many layouts, with menus,
headers, sidebars, notices, adverts, forms, comments and footers before, beside, inside and after an article, named as
web pages name them, or not named at all.
"""

from __future__ import annotations

import random
from html import escape, unescape

# Names that classes and ids of web pages have, by what they hold.
NAMES = {
    "content": "content main post entry article story body text post-content entry-content article-body post-body story-body"
    " main-content page-content articleBody mainText post-text hentry prose page read",
    "menu": "nav navbar menu navigation topnav breadcrumb breadcrumbs main-menu site-nav toc links pagination pager tabs skip-link"
    " dropdown submenu toolbar nav-links quicklinks sitemap",
    "header": "header masthead site-header top topbar branding logo page-header tagline site-title brand hero-banner",
    "footer": "footer site-footer bottom copyright legal colophon page-footer imprint footer-links credits",
    "sidebar": "sidebar side widget widgets rail right-column left-column related recommended popular trending tags tag-cloud"
    " archive categories more-stories latest most-read see-also side-bar relatedPosts secondary",
    "notice": "cookie cookies consent cookie-banner notice alert gdpr popup modal overlay newsletter subscribe signup paywall"
    " disclaimer toast message warning announcement privacy cookie-notice",
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adsense ad-slot banner-ad commercial partner"
    " affiliate banner ad-container adBox",
    "comments": "comment comments comment-list comment-body commentary discussion replies reply respond disqus thread"
    " reader-comments user-comments feedback comment-text reviews",
    "form": "form login search search-form contact-form signup-form register subscribe-form searchbox comment-form",
    "share": "share social share-buttons social-links sharing follow print tools",
}
ROLES = {
    "content": ("main", "article"), "menu": ("navigation",), "header": ("banner",), "footer": ("contentinfo",),
    "sidebar": ("complementary",), "notice": ("alert", "dialog", "alertdialog"), "form": ("search", "form"),
}
PHRASES = {
    "menu": "Home|About us|Contact|Products|News|Sports|Login|Next|Previous|Back to top|Skip to content|Startseite|Accueil|Inicio",
    "header": "Welcome to our site|The daily paper|Toggle navigation|Your trusted source",
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Powered by our team|Contact us · About · Jobs"
    "|Alle Rechte vorbehalten.|Tous droits réservés.|Todos los derechos reservados.",
    "sidebar": "Related articles|Most read|Popular posts|Tags|Archive|Categories|You may also like|More stories|Recent posts",
    "notice": "We use cookies to improve your experience.|Accept all cookies|Subscribe to our newsletter|This site uses cookies."
    "|Please enable JavaScript.|Sign up for free|Wir verwenden Cookies.|Nous utilisons des cookies.|Usamos cookies.",
    "advert": "Advertisement|Sponsored|Buy now and save 50%|Limited offer!|Click here|Anzeige|Publicité|Publicidad|Shop now",
    "comments": "Comments|Leave a reply|3 comments|Reply|Posted by a reader|Great post, thanks!|Kommentare|Commentaires|Comentarios",
    "form": "Your name|E-mail|Password|Search|Send|Submit|Remember me",
    "share": "Share|Tweet|Share on social media|Print this page|Follow us",
}
TAGS = {
    "content": ("article", "main", "div", "section"), "menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"),
    "sidebar": ("aside", "div", "section"), "notice": ("div", "div", "section", "aside", "p"), "advert": ("div", "div", "aside", "section", "p"),
    "comments": ("section", "div", "div", "ol", "ul", "article"), "form": ("form",), "share": ("div", "ul", "p"),
    "unseen": ("div", "p", "section"),
}
# Elements that tell by themselves what they hold.
PLAIN = {"content": ("article", "main"), "menu": ("nav",), "header": ("header",), "footer": ("footer",), "sidebar": ("aside",), "form": ("form",)}
SYLLABLES = "ba be bi co cu da de di fa fe ga go ha he in ja ka la le li ma me mi na ne no on pa re ri sa se si ta te ti un va ve wo za".split()


def rng_join(rng: random.Random, parts: list[str]) -> str:
    return rng.choice((" &gt; ", " / ", " » ")).join(parts)


class PageMaker:
    """Makes one page; ``main`` collects the texts of its blocks that belong to the article."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.main: list[str] = []
        self.named = rng.random() < 0.75

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randrange(1, 5)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randrange(low, high)))

    def sentences(self, low: int, high: int) -> str:
        parts = [self.words(1, self.rng.choice((4, 12, 25))).capitalize() for _ in range(self.rng.randrange(low, high))]
        return " ".join(p + self.rng.choice("....!?") for p in parts)

    def element(self, kind: str, inner: str, unnamed: bool = False) -> str:
        tags = PLAIN.get(kind, TAGS[kind]) if unnamed else TAGS[kind]
        tag = self.rng.choice(tags)
        marks = ""
        if not unnamed or kind not in PLAIN:
            if self.rng.random() < 0.85 or tag not in PLAIN.get(kind, ()):
                names = self.rng.sample(NAMES[kind].split(), self.rng.choice((1, 1, 2)))
                if self.rng.random() < 0.3:
                    names.append(self.word())
                marks += f' {self.rng.choice(("class", "class", "id"))}="{" ".join(names)}"'
            if kind in ROLES and self.rng.random() < 0.1:
                marks += f' role="{self.rng.choice(ROLES[kind])}"'
        return f"<{tag}{marks}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        given = [self.phrase("menu") if self.rng.random() < 0.2 else self.words(1, 4) for _ in range(self.rng.randrange(low, high))]
        anchors = [f'<a href="/{self.word()}">{escape(g)}</a>' for g in given]
        kind = self.rng.randrange(6)
        if kind == 4:  # a path to the page
            return rng_join(self.rng, anchors) + escape(self.rng.choice(("", " > ", " / ")) + self.words(1, 6))
        if kind == 5:
            return self.words(1, 3).capitalize() + ": " + ", ".join(anchors)
        if kind < 2:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in anchors) + "</ul>"
        return " | ".join(anchors) if kind == 2 else "".join(f"<div>{a}</div>" for a in anchors)

    def phrase(self, kind: str) -> str:
        return self.rng.choice(PHRASES[kind].split("|"))

    def clutter(self, kind: str, named: bool = False) -> str:
        unnamed = not (self.named or named) and kind in PLAIN
        rng = self.rng
        if kind == "menu":
            inner = self.links(3, 12)
        elif kind == "header":
            form = rng.choice(("<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", "{}", f"<h1>{{}}</h1><p>{self.sentences(1, 3)}</p>"))
            inner = form.format(escape(rng.choice((self.phrase(kind), self.words(1, 5)))))
            inner += self.links(2, 6) if rng.random() < 0.4 else ""
        elif kind == "footer":
            inner = rng.choice(("<p>{}</p>", "{}", "<div>{}</div>")).format(rng.choice((escape(self.phrase(kind)), f"&copy; {self.word()}.org &middot; {self.sentences(1, 3)}", self.sentences(1, 3))))
            inner += self.links(2, 8) if rng.random() < 0.4 else ""
        elif kind == "sidebar":
            inner = f"<h3>{escape(rng.choice((self.phrase(kind), self.words(1, 4))))}</h3>"
            inner += rng.choice((self.links(2, 8), f"<p>{self.sentences(1, 4)}</p>", f"<p>{self.sentences(2, 9)}</p><p>{self.sentences(1, 5)}</p>"))
        elif kind in ("notice", "advert"):
            inner = rng.choice((escape(self.phrase(kind)), self.sentences(1, 3), self.sentences(1, 6), f"<p>{self.sentences(1, 5)}</p>", f"<h4>{self.words(1, 6)}</h4><p>{self.sentences(1, 4)}</p>"))
            inner += f"<button>{self.phrase('notice')}</button>" if rng.random() < 0.2 else ""
        elif kind == "comments":
            inner = f"<h3>{escape(self.phrase(kind))}</h3>" if rng.random() < 0.7 else ""
            for _ in range(rng.randrange(1, 7)):
                body = rng.choice(("{}", "<p>{}</p>", "<p>{}</p>")).format(self.sentences(1, 6))
                inner += rng.choice(('<div class="comment">{}</div>', "<li>{}</li>", "<article>{}</article>", "<div>{}</div>", "{}<hr>")).format(
                    (f"<b>{self.word()}</b><br>" if rng.random() < 0.4 else "") + body
                )
        elif kind == "form":
            fields = (f"<label>{self.phrase(kind)}</label><input name='x'>" for _ in range(rng.randrange(1, 4)))
            inner = "".join(fields) + f"<button>{self.phrase(kind)}</button><textarea>{self.words(1, 9)}</textarea>"
        elif kind == "unseen":
            hidden = rng.choice((' style="display:none"', ' style="display: none;"', " hidden", ' aria-hidden="true"'))
            tag = rng.choice(TAGS[kind])
            return f"<{tag}{hidden}>{self.sentences(1, 5)}</{tag}>"
        else:
            inner = rng.choice((self.links(2, 5), escape(self.phrase("share"))))
        return self.element(kind, inner, unnamed)

    def odd_text(self) -> str:
        """What an article may hold besides sentences and headings."""
        rng = self.rng
        many = [self.word() for _ in range(rng.randrange(2, 40))]
        return rng.choice(
            (
                " | ".join(many),
                " ".join(str(rng.randrange(10 ** rng.randrange(1, 9))) for _ in many),
                " ".join([self.word()] * len(many)),
                f"https://{self.word()}.org/{self.word()} {self.words(1, 9)}",
                f"{self.word()}@{self.word()}.com, {self.word()} {rng.randrange(10**7)}",
                self.words(1, 30),
                escape(self.phrase(rng.choice(sorted(PHRASES)))),
                f"Copyright © {rng.randrange(1990, 2030)} {self.words(1, 6)}. {self.sentences(1, 3)}",
            )
        )

    def article_block(self) -> str:
        block = self.plain_block()
        if self.named and self.rng.random() < 0.04 and block.startswith("<p>"):
            names = self.rng.sample([*NAMES["content"].split(), "lead", "intro", "summary", "quote", self.word()], 1)[0]
            return f'<p class="{names}">{block[3:]}'
        return block

    def plain_block(self) -> str:
        rng = self.rng
        kind = rng.random()
        if kind < 0.1:
            text, form = self.odd_text(), rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>"))
        elif kind < 0.72:
            text = self.sentences(1, rng.choice((2, 4, 9)))
            form = rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>"))
            if rng.random() < 0.15:
                first, _, rest = text.partition(" ")
                self.main.append(text)
                return form.format(f'<a href="/x">{first}</a> {rest}')
        elif kind < 0.82:
            text, form = self.words(1, 8).capitalize(), rng.choice(("<h2>{}</h2>", "<h3>{}</h3>"))
        elif kind < 0.9:
            items = [rng.choice((self.words(1, 9), self.sentences(1, 3))) for _ in range(rng.randrange(2, 6))]
            self.main += items
            tag = rng.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{tag}>"
        elif kind < 0.95:
            text, form = self.sentences(1, 4), rng.choice(("<blockquote>{}</blockquote>", "<pre>{}</pre>", "<blockquote><p>{}</p></blockquote>"))
        else:
            text, form = self.words(2, 9).capitalize(), "<figure><img src='x'><figcaption>{}</figcaption></figure>"
        self.main.append(unescape(text))
        return form.format(text)

    def page(self) -> str:
        rng = self.rng
        title = self.words(2, 9).capitalize() + rng.choice(("", "", "."))
        parts = []
        if rng.random() < 0.95:
            self.main.append(title)
            heading = f"<h1>{title}</h1>"
            parts.append(f"<header>{heading}</header>" if rng.random() < 0.15 else heading)
        inside = ("advert", "share", "sidebar", "notice", "menu", "comments", "form", "unseen", "footer")
        for _ in range(rng.choice((1, 1, 2, 4, 8, 16))):
            parts.append(self.article_block())
            if rng.random() < 0.16:
                parts.append(self.clutter(rng.choice(inside), named=True))
        if rng.random() < 0.12:
            parts.append(self.clutter(rng.choice(("comments", "share", "form"))))
        article = self.element("content", "".join(parts), not self.named)
        for _ in range(rng.choice((0, 0, 1, 2))):
            article = rng.choice(('<div id="{}">{}</div>', '<div class="{}">{}</div>', "<main>{1}</main>", "<div>{1}</div>")).format(
                rng.choice(("content", "wrapper", "container", "page", "main", "layout", "site")), article
            )
        before = [k for k in ("notice", "header", "menu", "advert", "form") if rng.random() < (0.6 if k == "menu" else 0.35)]
        after = [k for k in ("sidebar", "comments", "advert", "form", "share", "notice", "menu") if rng.random() < 0.3]
        rng.shuffle(before)
        rng.shuffle(after)
        if rng.random() < 0.8:
            after.append("footer")
        if rng.random() < 0.1:
            before.append(rng.choice(("sidebar", "unseen")))
        if rng.random() < 0.05:
            after.append(rng.choice(("unseen", "header")))
        body = "".join(map(self.clutter, before)) + article + "".join(map(self.clutter, after))
        if rng.random() < 0.05:  # an article without any frame
            body = "".join(parts)
        end = "</body></html>" if rng.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body>{body}{end}"


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[str]]]:
    """Pages and, in order, the texts of the blocks of each that are its main text."""
    rng = random.Random(seed)
    made = []
    for _ in range(count):
        maker = PageMaker(rng)
        page = maker.page()
        made.append((page, maker.main))
    return made
