"""Labelled pages: many layouts of articles among menus, notices, adverts, comments and more.

Each page is made from a seed: a layout, the names its elements go by, and invented sentences.
Its main text, the lines that an extraction should give, is known by construction.
"""

from __future__ import annotations

import html as entities
import random
from functools import lru_cache

# Syllables of the invented words; accents and several endings, so that no language is learned.
SYLLABLES = "an ber che con de en er es für gen hal in je ka lo mi né on pre qui ra sch ta un ver wo zu ó è".split()

# What parts of pages are called on the web.
ARTICLE = "article post entry content story main text body page copy".split()
NAMES = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs topnav links pagination pager toc".split(),
    "header": "header masthead top site-header branding logo banner".split(),
    "footer": "footer bottom site-footer copyright colophon legal credits".split(),
    "side": "sidebar aside side widget related recommended popular trending rail more promo-list secondary complementary".split(),
    "notice": "notice cookie cookies consent gdpr alert banner message popup modal dialog newsletter warning announcement overlay".split(),
    "ad": "ad ads advert adverts advertisement sponsored sponsor promo promotion dfp adslot banner-ad".split(),
    "form": "form search subscribe signup login newsletter contact".split(),
    "comments": "comments comment commentlist discussion replies reply responses disqus respond thread".split(),
    "share": "share social sharing tags tools meta buttons".split(),
}


@lru_cache(maxsize=1)
def _vocabulary() -> list[str]:
    draw = random.Random(0)
    return ["".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(4000)]


class _Page:
    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)
        # Some pages name everything by class, some by tags alone.
        self.named = self.random.choice([0.0, 0.5, 1.0, 1.0, 1.0])
        self.semantic = self.random.choice([0.0, 0.5, 1.0, 1.0])
        self.unclosed = self.random.random() < 0.3
        self.main: list[str] = []

    def words(self, n: int) -> list[str]:
        return self.random.choices(_vocabulary(), k=n)

    def sentence(self, n: int | None = None) -> str:
        words = self.words(n or self.random.randint(1, 22))
        for _ in range(self.random.randint(0, len(words) // 6)):
            at = self.random.randrange(len(words))
            if at + 1 < len(words):
                words[at] += ","
        text = " ".join(words)
        return text[:1].upper() + text[1:] + self.random.choice([".", ".", ".", "?", "!"])

    def prose(self, sentences: int) -> str:
        return " ".join(self.sentence() for _ in range(sentences))

    def name(self, kind: str | None, sure: bool = False) -> str:
        """A class or id that says what an element is, or one that does not."""
        if kind is None or not sure and self.random.random() >= self.named:
            return "" if self.random.random() < 0.5 else f' class="{self.random.choice(["box", "row", "wrap", "inner", "col", "block", "c1", "module"])}"'
        word = self.random.choice(ARTICLE if kind == "article" else NAMES[kind])
        shape = self.random.choice(["{}", "{}", "{}-box", "site-{}", "c-{}__item", "{}-wrapper", "wp-{}", "js {}"]).format(word)
        return f' {self.random.choice(["class", "class", "id"])}="{shape}"'

    def tagged(self, tag: str, kind: str | None, body: str) -> str:
        """An element that its tag or its name tells apart, at least one of both."""
        plain = self.random.random() >= self.semantic
        return f"<{'div' if plain else tag}{self.name(kind, sure=plain)}>{body}</{'div' if plain else tag}>"

    def block(self, tag: str, text: str, main: bool, close: bool = True) -> str:
        inner = entities.escape(text, quote=False)
        if self.random.random() < 0.1:
            inner = inner.replace(" ", self.random.choice(["\n  ", "&#32;", "<br>", "  "]), 1)
        if self.random.random() < 0.2 and " " in inner:
            cut = inner.index(" ")
            mark = self.random.choice(["b", "em", "span", 'a href="/x"', "strong"])
            inner = f"<{mark}>{inner[:cut]}</{mark.split()[0]}>{inner[cut:]}"
        if main:
            self.main.append(text)
        return f"<{tag}>{inner}" + (f"</{tag}>" if close else "")

    def links(self, n: int) -> str:
        items = [f'<li><a href="/{w}">{" ".join(self.words(self.random.randint(1, 4)))}</a></li>' for w in self.words(n)]
        return f"<ul>{''.join(items)}</ul>" if self.random.random() < 0.7 else " | ".join(i[4:-5] for i in items)

    def article(self) -> str:
        r, out = self.random, []
        plain = "div" if r.random() < 0.15 else "p"
        if r.random() < 0.85:
            out.append(self.block("h1", self.prose(1) if r.random() < 0.5 else " ".join(self.words(r.randint(1, 12))), True))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            pick = r.random()
            if pick < 0.72:
                out.append(self.block(plain, self.prose(r.choice([1, 1, 2, 4, 7, 12])), True, plain == "div" or not self.unclosed))
            elif pick < 0.80:
                out.append(self.block(r.choice(["h2", "h3"]), " ".join(self.words(r.randint(1, 7))), True))
            elif pick < 0.87:
                items = [self.block("li", self.prose(1), True, not self.unclosed) for _ in range(r.randint(1, 5))]
                out.append(f"<ul>{''.join(items)}</ul>")
            elif pick < 0.90:
                out.append(f"<blockquote>{self.block('p', self.prose(2), True)}</blockquote>")
            elif pick < 0.92:
                out.append(f"<table><tr>{self.block('td', self.prose(1), True)}{self.block('td', self.prose(1), True)}</tr></table>")
            elif pick < 0.94:
                out.append(self.block("div", self.prose(3), True))
            elif pick < 0.97:
                out.append(self.tagged("aside", r.choice(["ad", "side"]), self.block("p", self.prose(r.randint(1, 3)), False)))
            else:
                out.append(f"<div{self.name('share', sure=True)}>{self.links(3)}</div>")
        if not out:
            out.append(self.block("p", self.prose(1), True))
        return "\n".join(out)

    def extra(self, kind: str) -> str:
        r = self.random
        if kind == "nav":
            return self.tagged("nav", "nav", self.links(r.randint(2, 8)))
        if kind == "header":
            return self.tagged("header", "header", self.block(r.choice(["div", "p", "h2"]), " ".join(self.words(r.randint(1, 6))), False) + (self.links(4) if r.random() < 0.5 else ""))
        if kind == "footer":
            line = f"&copy; {r.randint(1990, 2030)} {' '.join(self.words(3))}" if r.random() < 0.7 else self.prose(1)
            return self.tagged("footer", "footer", f"<p>{line} &middot; {self.sentence()}</p>" if r.random() < 0.5 else f"{line} {self.links(3) if r.random() < 0.5 else self.sentence()}")
        if kind == "side":
            body = self.block("h3", " ".join(self.words(2)), False) + (self.links(5) if r.random() < 0.6 else self.block("p", self.prose(r.randint(1, 4)), False))
            return self.tagged("aside", "side", body)
        if kind == "notice":
            return f"<div{self.name('notice', sure=True)}>{self.block('p', self.prose(r.randint(1, 3)), False)}<button>{self.words(1)[0]}</button></div>"
        if kind == "ad":
            body = entities.escape(self.prose(r.randint(1, 3)))
            tag = r.choice(["div", "div", "section", "aside", "p"]) if r.random() < 0.5 else "div"
            return f"<{tag}{self.name('ad', sure=True)}>{body}</{tag}>"
        if kind == "form":
            return f"<form{self.name('form')}><label>{self.sentence(4)}</label><input name=q><select><option>{self.words(1)[0]}<option>{self.words(1)[0]}</select><p>{self.prose(1)}</p><button>{self.words(1)[0]}</button></form>"
        if kind == "comments":
            tag = r.choice(["li", "div", "article"])
            each = [f"<{tag}{self.name('comments')}>{self.block('h4', ' '.join(self.words(2)), False)}{self.block('p', self.prose(r.choice([1, 2, 4])), False)}</{tag}>" for _ in range(r.randint(1, 3))]
            around = r.choice(["section", "div", "ol"])
            return f"<{around}{self.name('comments', sure=True)}><h3>{' '.join(self.words(2))}</h3>{''.join(each)}</{around}>"
        return f"<div{self.name('share', sure=True)}>{self.links(3)}</div>"

    def make(self) -> str:
        r = self.random
        before = [k for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < 0.4]
        after = [k for k in ("share", "ad", "side", "comments", "form", "nav", "notice") if r.random() < 0.3]
        inside = [k for k in ("comments", "share", "side") if r.random() < 0.12]
        r.shuffle(before)
        r.shuffle(after)
        top = "".join(self.extra(k) for k in before)
        body = self.article() + "".join(self.extra(k) for k in inside)
        tag = r.choice(["article", "article", "main", "section", "div", "div", "td", ""])
        if tag == "td":
            body = f"<table><tr><td{self.name('article')}>{body}</td></tr></table>"
        elif tag:
            body = f"<{tag}{self.name('article', sure=tag == 'div' and r.random() < 0.8)}>{body}</{tag}>"
        if r.random() < 0.3:
            body = f"<main><div{self.name(None)}>{body}</div></main>"
        if r.random() < 0.05:
            return body
        bottom = "".join(self.extra(k) for k in after) + (self.extra("footer") if r.random() < 0.8 else "")
        # Names of an article are given to what holds the whole page, too.
        while r.random() < 0.4:
            name = r.choice(["page", "site", "content", "main", "wrapper", "container", "layout", "body", "story-page", "post-page"])
            whole = f' {r.choice(["class", "id"])}="{name}"'
            if r.random() < 0.5:
                body, bottom = f"<{r.choice(['div', 'main'])}{whole}>{body}{bottom}</div></main>", ""
            else:
                top, bottom = f"<div{whole}>{top}", f"{bottom}</div>"
        title = " ".join(self.words(5))
        head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        page = f"{head}<body{self.name(None)}>{top}<!-- {title} -->{body}{bottom}</body></html>"
        return page if r.random() < 0.9 else page.removesuffix("</body></html>")


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A page and the lines of its main text."""
    page = _Page(seed)
    return page.make(), [" ".join(line.split()) for line in page.main]
