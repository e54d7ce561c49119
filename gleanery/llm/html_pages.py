"""Labelled pages to train the extractor on, made from random parts.

A page is put together as such pages commonly are: semantic tags or divs with
telling classes, unclosed tags, main text with adverts, share bars and forms
in between, comments, sidebars, notices. Blocks of the main text carry the
attribute data-main, which the extractor reads as a label and never as a feature.
"""

from __future__ import annotations

from random import Random

MARK = ' data-main="1"'
#: Class and id words that pages commonly use, by part.
NAMES = {
    "header": "header masthead site-header top page-header topbar brand hero-header",
    "nav": "nav menu navbar navigation main-menu mainnav topnav site-nav menu-list tabs",
    "crumbs": "breadcrumb breadcrumbs crumbs path trail",
    "notice": "cookie cookies notice consent alert gdpr cookie-banner notification popup modal announcement cookie-notice warning overlay",
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot ad-box banner-ad promotion adsbox advert-box",
    "sidebar": "sidebar side widget rail related aside secondary sidebar-right popular trending recommended widget-area",
    "comments": "comments comment-list responses discussion replies comment-section disqus reader-comments comments-area feedback",
    "comment": "comment reply response comment-body comment-item",
    "share": "share social share-bar sharing follow social-links",
    "form": "search form newsletter subscribe login signup search-form contact-form",
    "footer": "footer site-footer bottom copyright page-footer colophon foot legal",
    "outer": "container wrapper page main layout content site row grid inner wrap body primary col",
    "article": "article post entry story content post-body entry-content text article-body main-content story-body post-content body-text page-content",
}
MENU_WORDS = "Home About Contact News Login Products Help Blog Archive Search FAQ Impressum Inicio Accueil Kontakt Sport Wetter"
SYLLABLES = "an be ch da en er fo ga he in ja ke la mi no ou pa que re st ti un ver wi zu tion ment lich ció ñ é ü ß"


class Maker:
    def __init__(self, seed: int):
        self.pick = Random(seed)
        self.syllables = SYLLABLES.split()
        self.style = ""

    def word(self) -> str:
        return "".join(self.pick.choices(self.syllables, k=self.pick.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.pick.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        found = []
        for _ in range(self.pick.randint(low, high)):
            s = self.words(1, 3) if self.chance(0.15) else self.words(4, 22)
            found.append(s[:1].upper() + s[1:] + self.pick.choice(".....?!"))
        return " ".join(found)

    def chance(self, p: float) -> bool:
        return self.pick.random() < p

    def named(self, part: str) -> str:
        name = self.pick.choice(NAMES[part].split())
        if self.chance(0.25):
            name += " " + self.pick.choice(["clearfix", "mt-4", "box", "small", "x" + str(self.pick.randint(1, 99)), *NAMES[part].split()])
        return f' {"id" if self.chance(0.25) else "class"}="{name}"'

    def element(self, tag: str, part: str, inner: str, plain: float) -> str:
        """The semantic tag, with or without a name, or a div or section with one."""
        if tag and self.chance(0.5):
            return f"<{tag}{self.named(part) if self.chance(0.4) else ''}>{inner}</{tag}>"
        kind = self.pick.choice(["div", "div", "div", "section"])
        return f"<{kind}{'' if self.chance(plain) else self.named(part)}>{inner}</{kind}>"

    def links(self, low: int, high: int, listed: bool = True) -> str:
        names = MENU_WORDS.split()
        texts = [self.pick.choice(names) if self.chance(0.5) else self.words(1, 4) for _ in range(self.pick.randint(low, high))]
        made = [f'<a href="/{i}">{t}</a>' for i, t in enumerate(texts)]
        return "<ul>" + "".join(f"<li>{a}</li>" for a in made) + "</ul>" if listed else self.pick.choice([" | ", " ", " » ", " · "]).join(made)

    def styled(self, text: str) -> str:
        """Main text need not be prose: it may lack stops, repeat words, or hold marks."""
        if self.style == "marks":
            return " ".join(w + self.pick.choice(["%%%", "$$$", "###", "&amp;&amp;&amp;", "***"]) for w in text.split())
        if self.style == "bars":
            return " | ".join(text.split())
        if self.style == "no stops":
            return text.replace(".", "").replace("!", "").replace("?", "")
        if self.style == "repeats":
            return " ".join(" ".join([w] * self.pick.randint(2, 6)) for w in text.replace(".", "").split())
        return text

    def block(self) -> str:
        """One block of the main text."""
        text, kind = self.styled(self.sentences(1, 7)), self.pick.random()
        if self.chance(0.15):
            text = self.words(1, 2).capitalize() + "." * self.chance(0.8)
        if self.chance(0.15):
            text = f'{text} <a href="/{self.word()}">{self.words(1, 3)}</a> {self.sentences(1, 2)}'
        if self.chance(0.2):
            text = f"<b>{text}" + ("</b>" if self.chance(0.5) else "<br>")
        if kind < 0.72:
            return f"<p{MARK}>{text}" + ("</p>" if self.chance(0.85) else "")
        if kind < 0.8:
            return f"<{(h := self.pick.choice(['h2', 'h3']))}{MARK}>{self.words(1, 8)}</{h}>"
        if kind < 0.86:
            listed = self.pick.choice(["ul", "ol"])
            return f"<{listed}>" + "".join(f"<li{MARK}>{self.sentences(1, 2) if self.chance(0.6) else self.words(1, 6)}</li>" for _ in range(self.pick.randint(2, 6))) + f"</{listed}>"
        if kind < 0.9:
            return f"<blockquote><p{MARK}>{text}</p></blockquote>"
        if kind < 0.93:
            return "<table>" + "".join(f"<tr><td{MARK}>{self.words(1, 3)}</td><td{MARK}>{self.words(1, 6)}</td></tr>" for _ in range(self.pick.randint(1, 4))) + "</table>"
        return f"<div{MARK}>{text}</div>"

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input type=text name=q><button>{self.words(1, 2)}</button>"
        if self.chance(0.4):
            inner += "<select>" + "".join(f"<option>{self.words(1, 2)}</option>" for _ in range(4)) + "</select>"
        if self.chance(0.4):
            inner = f"<p>{self.sentences(1, 2)}</p>" + inner
        return f"<form{self.named('form') if self.chance(0.5) else ''}>{inner}</form>"

    def ad(self) -> str:
        inner = self.sentences(1, 3) if self.chance(0.6) else self.links(1, 2, False)
        return self.element("aside" if self.chance(0.3) else "", "ad", f"<p>{inner}</p>" if self.chance(0.4) else inner, 0)

    def notice(self) -> str:
        inner = f"<p>{self.sentences(1, 3)}</p>" if self.chance(0.6) else self.sentences(1, 2)
        return self.element("", "notice", inner + ("<button>OK</button>" if self.chance(0.5) else ""), 0)

    def comments(self) -> str:
        one = lambda: self.element("", "comment", f"<p>{self.sentences(1, 3)}</p>" if self.chance(0.7) else self.sentences(1, 2), 0.3)
        inner = f"<h3>{self.words(1, 2)}</h3>" * self.chance(0.6) + "".join(one() for _ in range(self.pick.randint(1, 6)))
        return self.element("", "comments", inner + self.form() * self.chance(0.3), 0)

    def sidebar(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" * self.chance(0.6) + (self.links(2, 8) if self.chance(0.6) else f"<p>{self.sentences(1, 3)}</p>")
        return self.element("aside", "sidebar", inner, 0)

    def page(self) -> str:
        title = self.words(2, 9)
        self.style = self.pick.choice(["marks", "bars", "no stops", "repeats"]) if self.chance(0.2) else ""
        inside = []
        for _ in range(1 + int(self.pick.expovariate(0.12))):
            inside.append(self.block())
            if self.chance(0.04):
                inside.append(self.pick.choice([self.ad, self.form, self.sidebar, self.notice, lambda: self.element("", "share", self.links(2, 5), 0)])())
        main = f"<h1{MARK}>{title}</h1>" * self.chance(0.85) + "".join(inside)
        if self.chance(0.15):
            main += self.comments()
        main = self.element("article", "article", main, 0.05)
        around = [("header", self.element("header", "header", f"<h1>{self.words(1, 3)}</h1>" * self.chance(0.3) + (f"<p>{self.words(2, 8)}</p>" if self.chance(0.5) else self.links(2, 6)), 0), 0.4)]
        around += [("nav", self.element("nav", "nav", self.links(3, 12, self.chance(0.8)), 0), 0.8), ("crumbs", self.element("", "crumbs", self.links(2, 4, False), 0), 0.2)]
        around += [("notice", self.notice(), 0.3), ("ad", self.ad(), 0.5)]
        after = [(self.comments(), 0.3), (self.sidebar(), 0.4), (self.ad(), 0.2), (self.form(), 0.2), (self.notice(), 0.15)]
        before = [html for _, html, p in around if self.chance(p)]
        behind = [html for html, p in after if self.chance(p)]
        self.pick.shuffle(behind)
        foot = f"&copy; {self.word()} {self.sentences(1, 2)}" if self.chance(0.6) else f"<p>{self.words(2, 8)}</p>" + self.links(1, 5)
        foot = self.element("footer", "footer", foot, 0) * self.chance(0.85)
        if self.chance(0.5):
            main = self.element("main", "outer", main + "".join(behind), 0.2)
            behind = []
        body = "".join(before) + main + "".join(behind) + foot
        if self.chance(0.3):
            body = f'<div class="{self.pick.choice(NAMES["outer"].split())}">{body}</div>'
        head = f"<title>{title}</title><style>p{{margin:0}}</style><script>var a='<p>';</script>"
        return f"<!DOCTYPE html><html><head>{head}</head><body>{body}" + "</body></html>" * self.chance(0.9)


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
