"""Generated web pages with known main text, to train the block labeller on.

Every page draws its own words, layout, element kinds and class names. The body is
written in paragraphs, in bare ``div``s, in texts parted by ``br``, or in a mix, with
lists, tables, definitions and figures of any length down to one word. For one page
in four the names mean nothing, and one in eight has none, so that the labeller
also learns from the form and order of blocks. Common words, and words that
notices and menus like, are in main texts too: no word tells a block by itself.
"""

from __future__ import annotations

import html

import numpy as np

SYLLABLES = "an ar be bo ca ch co da de di do ei el en er es et eu fa fi ga ge ha he hi in ion is it ka ke la le li lo ma me mi mo na ne ni no nt on or ou pa pe po qu ra re ri ro sa se sh si st su ta te th ti to tr u un ur va ve vi wa we za ze é è ä ö ü ñ ó".split()
NAMES = {
    "nav": "nav menu navbar main-nav navigation site-nav topnav links",
    "crumbs": "breadcrumb breadcrumbs crumbs path",
    "header": "header site-header masthead top banner-top brand",
    "notice": "cookie cookie-notice consent notice alert gdpr announcement message notification popup modal",
    "ad": "ad ads advert advertisement sponsored promo banner ad-slot adsense sponsor promotion commercial",
    "side": "sidebar side aside widget right-column secondary rail",
    "related": "related more-stories recommended see-also read-next popular trending",
    "share": "share social sharing follow buttons",
    "form": "newsletter subscribe signup search search-form login contact-form",
    "comments": "comments comment-list discussion replies responses reader-comments commentlist disqus",
    "comment": "comment reply comment-body response",
    "footer": "footer site-footer bottom copyright legal colophon",
    "article": "article post content entry entry-content story post-body article-body main-content text body page-content",
}
SAYINGS = {
    "nav": "Home News About Contact Sport Culture Shop Blog Archive Help Login Products Services",
    "notice": "We use cookies to improve your experience . By continuing you accept our privacy policy . Accept all Manage settings This site uses cookies Please enable Your browser is out of date",
    "ad": "Buy now Save 50 % today Limited offer Sponsored Advertisement Click here for the best deals Free shipping Shop the sale Order online",
    "form": "Email Name Subscribe Sign up for our newsletter Your address Search Send Submit Password Enter your email",
    "comment": "I agree Great post Thanks for sharing said wrote Reply Like Report I think this is wrong Nice article first",
    "footer": "Copyright All rights reserved Privacy Terms Imprint Contact Sitemap Powered by",
    "share": "Share Tweet Facebook Print Email Pin it Follow us",
    "related": "Read more Related articles You may also like Most read Popular posts",
}
#: Frequent words of English, French, German and Spanish.
COMMON = (
    "the of and to in is was for that it as with on by are this be at from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any my now such like our over man me even most made after also did many off before must well back through years where much your way down should because long each just those people how too little good world make very still see own work life here being day both few made "
    "le la les de des du et un une est que qui dans pour pas sur avec plus par son mais nous vous comme tout elle ils "
    "der die das und ist nicht von mit sich auf für den dem ein eine als auch es an werden aus er hat dass sie nach bei "
    "el los las y en por con para una su al lo como más pero sus ya todo esta entre cuando muy sin sobre ser"
).split()
WRAPPERS = "wrapper container page site row col inner wrap layout grid box outer".split()
THINGS = "salt flour water butter kg g cups min km 10 3 250 1,5 1998 12:30 40% €5 yes no left right red blue A B total name size price north".split()

SAID = [w.lower() for words in SAYINGS.values() for w in words.split()]


class Page:
    """One page in the making; ``main`` collects the texts of its main blocks."""

    def __init__(self, r: np.random.Generator):
        self.r, self.main = r, set()
        parts = iter(r.integers(0, len(SYLLABLES), 600).tolist())
        self.lexicon = ["".join(SYLLABLES[next(parts)] for _ in range(n)) for n in r.integers(1, 5, 120).tolist()]
        self.blank = r.random() < 0.25  # names mean nothing
        self.plain = r.random() < 0.12  # there are none
        self.common = r.random() * 0.6 * (r.random() < 0.7)
        self.style = str(r.choice(["p", "div", "br", "mixed"], p=[0.6, 0.2, 0.08, 0.12]))
        self.junk = ("%%%", "###", "&&&", "!!!")[int(r.integers(4))] if r.random() < 0.05 else ""
        self.end = "</p>" if self.style != "p" or r.random() < 0.75 else ""
        self.semantic = r.random() < 0.6  # uses nav, article, footer
        self.code: dict[str, str] = {}

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, n: int) -> list[str]:
        out = [self.lexicon[int(i)] for i in (self.r.random(n) ** 2 * len(self.lexicon))]
        if self.common:
            for of, share in ((COMMON, self.common), (SAID, 0.06)):
                for i in np.flatnonzero(self.r.random(n) < share):
                    out[i] = of[int(self.r.integers(len(of)))]
        return out

    def item(self) -> str:
        """A short text: a word, a quantity, a phrase."""
        x = self.r.random()
        if x < 0.3:
            return self.words(1)[0]
        if x < 0.6:
            return " ".join(str(w) for w in self.r.choice(THINGS, int(self.r.integers(1, 4))))
        return self.sentence(2, 8)[: None if self.chance(0.5) else -1]

    def sentence(self, lo: int = 3, hi: int = 18) -> str:
        w = self.words(int(self.r.integers(lo, hi)))
        if self.chance(0.015):  # a word that is stuck
            w[1:] = [w[-1]] * int(self.r.integers(1, 60))
        if self.junk and self.chance(0.3):
            w = [x + self.junk for x in w]
        w = [x + "," * bool(c) for x, c in zip(w, self.r.random(len(w)) < 0.08)]
        return w[0].capitalize() + "".join(" " + x for x in w[1:]) + "."

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(int(self.r.integers(1, most + 1))))

    def saying(self, kind: str, n: int) -> str:
        pool = SAYINGS.get(kind, SAYINGS["nav"]).split()
        at = int(self.r.integers(0, len(pool)))
        return " ".join((pool + pool)[at : at + n])

    def attr(self, kind: str) -> str:
        if self.plain or self.chance(0.12):
            return ""
        if self.blank:
            name = self.code.setdefault(kind, "".join(self.r.choice(list("abcdefghijkmnpqrstuvwxyz"), 5)))
        else:
            name = str(self.r.choice(NAMES[kind].split()))
            if self.chance(0.3):
                name += " " + "".join(self.r.choice(list("abcxyz"), 3))
        return f' {"id" if self.chance(0.25) else "class"}="{name}"'

    def tag(self, kind: str, semantic: str) -> str:
        return semantic if self.semantic and self.chance(0.85) else "div"

    def inline(self, text: str) -> str:
        """The text with some of its words in inline elements; entities for signs."""
        out = [html.escape(w, quote=False) for w in text.split(" ")]
        for i, x in enumerate(self.r.random(len(out)).tolist()):
            if x < 0.03:
                t = ("b", "i", "em", "strong", "span")[int(x * 166)]
                out[i] = f"<{t}>{out[i]}</{t}>"
            elif x < 0.05:
                out[i] = f'<a href="/{int(self.r.integers(0, 999))}">{out[i]}</a>'
        return (" " if self.chance(0.8) else "\n  ").join(out)

    def keep(self, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return self.inline(text)

    def list_of(self, kind: str, n: int, linked: float = 0.9) -> str:
        items = []
        for _ in range(n):
            t = html.escape(self.saying(kind, int(self.r.integers(1, 3))) if self.chance(0.4) else " ".join(self.words(int(self.r.integers(1, 4)))))
            if self.chance(0.2):
                t = t.capitalize() if self.chance(0.5) else t
                t += ("", ".", ",")[int(self.r.integers(3))]
            items.append(f'<li><a href="/x">{t}</a></li>' if self.chance(linked) else f"<li>{t}</li>")
        return f"<ul>{''.join(items)}</ul>" if self.chance(0.75) else "".join(i.replace("<li>", "<span>").replace("</li>", "</span> ") for i in items)

    def nav(self) -> str:
        t = self.tag("nav", "nav")
        return f"<{t}{self.attr('nav')}>{self.list_of('nav', int(self.r.integers(3, 10)))}</{t}>"

    def boiler(self, kind: str, semantic: str = "div") -> str:
        """A side block: of prose, of sayings, or of links."""
        t = self.tag(kind, semantic)
        if kind in ("notice", "ad", "share") and self.chance(0.5):  # a bar: one text, and what to press
            text = self.saying(kind, int(self.r.integers(2, 16))) if self.chance(0.7) else self.prose(2)
            press = "".join(f"<button>{self.saying(kind, 1)}</button>" if self.chance(0.6) else f'<a href="/c">{self.saying(kind, 2)}</a>' for _ in range(int(self.r.integers(0, 3))))
            return f"<{t}{self.attr(kind)}>{f'<p>{html.escape(text)}</p>' if self.chance(0.5) else html.escape(text)} {press}</{t}>"
        inner = []
        for _ in range(int(self.r.integers(1, 4))):
            x = self.r.random()
            if x < 0.35:
                inner.append(self.inline(self.prose(2)) if self.chance(0.5) else f"<p>{self.inline(self.prose(3))}</p>")
            elif x < 0.75:
                inner.append(f"<p>{html.escape(self.saying(kind, int(self.r.integers(2, 14))))}</p>")
            else:
                inner.append(self.list_of(kind, int(self.r.integers(2, 6))))
        if self.chance(0.3):
            inner.insert(0, f"<h3>{html.escape(self.saying(kind, 2))}</h3>")
        return f"<{t}{self.attr(kind)}>{''.join(inner)}</{t}>"

    def form(self) -> str:
        rows = "".join(f"<label>{self.saying('form', 1)}</label><input name=x>" for _ in range(int(self.r.integers(1, 4))))
        text = f"<p>{self.saying('form', 6) if self.chance(0.5) else self.inline(self.prose(2))}</p>" * self.chance(0.6)
        return f'<form{self.attr("form")} action="/s">{text}{rows}<button>{self.saying("form", 1)}</button></form>'

    def comments(self) -> str:
        t = self.tag("comments", "section")
        out = [f"<h3>{int(self.r.integers(1, 90))} comments</h3>" if self.chance(0.6) else ""]
        for _ in range(int(self.r.integers(1, 7))):
            who = f"<b>{self.words(1)[0]}</b> said" if self.chance(0.5) else f"<span>{self.words(1)[0]}</span>"
            text = self.inline(self.prose(4)) if self.chance(0.75) else self.saying("comment", 5)
            out.append(f"<div{self.attr('comment')}><p>{who}</p><p>{text}</p></div>" if self.chance(0.7) else f"<li{self.attr('comment')}>{text}</li>")
        return f"<{t}{self.attr('comments')}>{''.join(out)}</{t}>"

    def paragraph(self, text: str) -> str:
        style = str(self.r.choice(["p", "div", "br"])) if self.style == "mixed" else self.style
        if style == "div":
            return f"<div{self.attr('article') * self.chance(0.2)}>{self.keep(text)}</div>"
        if style == "br":
            return f"{self.broken(text)}<br><br>"
        lead = "<b>" if self.chance(0.06) else ""
        return f"<p{self.attr('article') * self.chance(0.06)}>{lead}{self.keep(text)}{'<br>' if lead else self.end}"

    def broken(self, text: str) -> str:
        """A text of a block that goes on after a line break."""
        self.open.append(" ".join(text.split()))
        return self.inline(text)

    def shut(self) -> str:
        """The border after texts parted by line breaks, which are one block."""
        if self.open:
            self.main.add(" ".join(self.open))
            self.open = []
        return ""

    def details(self) -> str:
        """Lists, tables, definitions, figures and quotations of an article."""
        x, n = self.r.random(), int(self.r.integers(1, 7))
        if x < 0.4:
            kind, one_by_one = str(self.r.choice(["ul", "ul", "ol"])), self.chance(0.5)
            return f"<{kind}>" + "".join(f"<li>{self.keep(self.item() if one_by_one else self.sentence(2, 12))}</li>" for _ in range(n + 1)) + f"</{kind}>"
        if x < 0.6:
            columns = int(self.r.integers(2, 4))
            row = lambda tag: "<tr>" + "".join(f"<{tag}>{self.keep(self.item() if self.chance(0.7) else self.sentence(1, 5))}</{tag}>" for _ in range(columns)) + "</tr>"
            return f"<table>{row('th') if self.chance(0.6) else ''}{''.join(row('td') for _ in range(n))}</table>"
        if x < 0.7:
            return "<dl>" + "".join(f"<dt>{self.keep(self.item())}</dt><dd>{self.keep(self.item() if self.chance(0.4) else self.prose(2))}</dd>" for _ in range(n)) + "</dl>"
        if x < 0.82:
            return f"<figure><img src=x.png><figcaption>{self.keep(self.item() if self.chance(0.4) else self.sentence(3, 14))}</figcaption></figure>"
        if x < 0.92:
            text = self.keep(self.prose(3))
            return f"<blockquote>{text if self.chance(0.5) else f'<p>{text}</p>'}</blockquote>"
        return f"<pre>{self.keep(self.prose(2))}</pre>"

    def article(self) -> str:
        parts, self.open = [], []
        title = self.sentence(2, 9)
        title = title if self.chance(0.4) else title[:-1]
        head = f"<h1>{self.keep(title)}</h1>" if self.chance(0.9) else ""
        if head and self.chance(0.15):
            head = f"<header>{head}</header>"
        parts.append(head)
        if self.chance(0.2):
            parts.append(f"<p><b>{self.keep(title if self.chance(0.5) else self.sentence())}<br>" if self.style == "p" else "")
        sections = self.chance(0.15)
        for _ in range(int(self.r.integers(1, 14))):
            x = self.r.random()
            if x < 0.72:
                parts.append(self.paragraph(self.prose(7) if self.chance(0.8) else self.sentence(1, 5)))
            elif x < 0.82:
                self.shut()
                level = int(self.r.integers(2, 5))
                parts.append(f"{'</section><section>' * sections}<h{level}>{self.keep(self.item() if self.chance(0.3) else self.sentence(2, 6)[:-1])}</h{level}>")
            else:
                self.shut()
                parts.append(self.details())
            if self.chance(0.05):
                self.shut()
                parts.append(self.boiler("ad"))
            if self.chance(0.02):
                self.shut()
                parts.append(self.boiler("related", "aside"))
            if self.chance(0.02):
                self.shut()
                parts.append(self.boiler("notice"))
        self.shut()
        body = "".join(parts)
        parts = [f"<section>{body}</section>" if sections else f"<div>{body}</div>" if self.chance(0.15) else body]
        if self.chance(0.15):
            parts.append(self.boiler("share"))
        if self.chance(0.12):
            parts.append(self.boiler("related", "aside"))
        if self.chance(0.12):
            parts.append(self.form())
        if self.chance(0.12):
            parts.append(self.comments())
        t = self.tag("article", str(self.r.choice(["article", "article", "main"])))
        return f"<{t}{self.attr('article') if t == 'div' or self.chance(0.4) else ''}>{''.join(parts)}</{t}>"

    def build(self) -> str:
        before = [(0.8, self.nav), (0.35, lambda: self.boiler("header", "header")), (0.2, lambda: self.boiler("notice")), (0.3, lambda: self.boiler("ad")), (0.15, self.form), (0.15, lambda: f"<div{self.attr('crumbs')}><a href=/>{self.words(1)[0]}</a> / <a href=/a>{self.words(1)[0]}</a></div>"), (0.15, lambda: self.boiler("side", "aside"))]
        after = [(0.3, self.comments), (0.25, lambda: self.boiler("side", "aside")), (0.2, lambda: self.boiler("related", "section")), (0.2, lambda: self.boiler("ad")), (0.12, self.form), (0.12, lambda: self.boiler("notice")), (0.15, self.nav)]
        first = [make() for p, make in before if self.chance(p)]
        last = [make() for p, make in after if self.chance(p)]
        if self.chance(0.4):
            self.r.shuffle(first)
            self.r.shuffle(last)
        foot = self.tag("footer", "footer")
        text = f"&copy; {self.words(1)[0]} {int(self.r.integers(1990, 2030))}" if self.chance(0.5) else self.saying("footer", 5)
        footer = f"<{foot}{self.attr('footer') if foot == 'div' else ''}>{text}{self.list_of('footer', 3) * self.chance(0.4)}</{foot}>" * self.chance(0.85)
        if self.chance(0.5):
            body = "".join(first) + self.article() + "".join(last) + footer
        elif self.chance(0.3):
            wrap = lambda x: f"<div>{x}</div>" if self.chance(0.5) else f'<div class="{self.r.choice(WRAPPERS)}">{x}</div>'
            body = wrap(wrap("".join(first)) + wrap(wrap(self.article()) + wrap("".join(last))) + footer)
        else:
            body = f"<div><div{self.attr('header')}>{''.join(first)}</div><div>{self.article()}</div>{''.join(last)}</div>{footer}"
        script = '<script>var t="</p>";f(1);</script>' * self.chance(0.5)
        return f"<!DOCTYPE html><html><head><title>{self.words(1)[0]}</title><style>p{{margin:0}}</style>{script}</head><body>{body}</body></html>"


def generate(r: np.random.Generator) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks."""
    page = Page(r)
    return page.build(), page.main
