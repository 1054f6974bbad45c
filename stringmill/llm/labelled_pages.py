"""Labelled pages for training, made from many small layouts with known roles.

The words are meaningless; what is to be learned is layout: which elements, names,
lengths and shares of links go with content, and which with the rest of a page.
"""

from __future__ import annotations

import random

from .htmltext import align, leaf_blocks

_SYLLABLES = "ka lo mi ten ra su vel dor ni pa cha un os ier keit ción the ing nd est la qu zu ô é".split()


class _Page:
    def __init__(self, rnd: random.Random):
        self.rnd = rnd
        self.parts: list[str] = []
        self.wanted: list[str] = []
        #: Some pages leave out end tags that the standard lets one leave out.
        self.lazy = rnd.random() < 0.3
        self.style = rnd.choice(["rows", "marks", "shout", "again"]) if rnd.random() < 0.2 else ""

    def word(self) -> str:
        return "".join(self.rnd.choice(_SYLLABLES) for _ in range(self.rnd.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rnd.randint(low, high)))

    def styled(self, text: str) -> str:
        """Poor text is content too: now and then a page has rows of marks, shouting or one word again and again."""
        if self.style == "rows":
            return text.replace(" ", " | ") + self.rnd.choice(["", " |"])
        if self.style == "marks":
            return " ".join(w + self.rnd.choice(["%%%", "###", "$$$", "***"]) for w in text.split())
        if self.style == "shout":
            return text.upper().replace(" ", "!! ")
        if self.style == "again":
            return " ".join([text.split()[0]] * len(text.split()))
        return text

    def sentence(self, low: int = 2, high: int = 30) -> str:
        return self.words(low, high).capitalize() + self.rnd.choice("....!?")

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rnd.randint(low, high)))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def put(self, html: str) -> None:
        self.parts.append(html)

    def content(self, tag: str, text: str, attributes: str = "", close: bool = True) -> None:
        """A block of main text, now and then with inline markup."""
        if self.style and self.rnd.random() < 0.7:
            text = self.styled(text)
        words = text.split(" ")
        if len(words) > 4 and self.rnd.random() < 0.4:
            k = self.rnd.randrange(len(words) - 2)
            inline = self.rnd.choice(["b", "i", "em", "strong", "span", "a href='/x'"])
            shown = " ".join([*words[:k], f"<{inline}>{words[k]}</{inline.split()[0]}>", *words[k + 1 :]])
        else:
            shown = text
        self.put(f"<{tag}{attributes}>{shown}" + (f"</{tag}>" if close and not (self.lazy and tag in ("p", "li")) else ""))
        self.wanted.append(text)


def _name(rnd: random.Random, words: str, kinds: str = "class id") -> str:
    return f' {rnd.choice(kinds.split())}="{rnd.choice(words.split(","))}"'


def _links(p: _Page, low: int, high: int) -> str:
    return "<ul>" + "".join(f"<li>{p.link()}</li>" for _ in range(p.rnd.randint(low, high))) + "</ul>"


def _navigation(p: _Page) -> None:
    r = p.rnd
    body = r.choice([lambda: _links(p, 3, 9), lambda: " ".join(p.link() for _ in range(r.randint(3, 9))), lambda: " | ".join(p.link() for _ in range(r.randint(3, 6)))])()
    tag, attributes = r.choice([("nav", ""), ("nav", _name(r, "menu,navbar,main-nav,nav")), ("div", _name(r, "menu,navbar,navigation,main-menu,topnav,breadcrumb,breadcrumbs")), ("ul", _name(r, "menu,nav,tabs"))])
    p.put(f"<{tag}{attributes}>{body}</{tag}>")


def _page_header(p: _Page) -> None:
    r = p.rnd
    tag, attributes = r.choice([("header", ""), ("header", _name(r, "site-header,masthead,top")), ("div", _name(r, "header,masthead,site-header,top-bar"))])
    p.put(f"<{tag}{attributes}><a href='/'>{p.words(1, 3)}</a>" + (f"<p>{p.sentence(2, 8)}</p>" if r.random() < 0.5 else "") + (f"<h1>{p.words(1, 3)}</h1>" if r.random() < 0.3 else ""))
    if r.random() < 0.5:
        _navigation(p)
    p.put(f"</{tag}>")


def _notice(p: _Page) -> None:
    r = p.rnd
    text = p.prose(1, 3)
    button = r.choice(["", f"<button>{p.words(1, 2)}</button>", f"<a href='#'>{p.words(1, 2)}</a>"])
    tag = r.choice(["div", "div", "section", "aside"])
    attributes = _name(r, "cookie-banner,cookie-notice,cookies,consent,gdpr,notice,alert,site-notice,notification,popup,modal,overlay,banner,paywall,subscribe-notice") + r.choice(["", " role='dialog'", " role='alert'"])
    p.put(f"<{tag}{attributes}>" + r.choice([f"<p>{text}</p>{button}", f"{text} {button}"]) + f"</{tag}>")


def _advert(p: _Page) -> None:
    r = p.rnd
    tag = r.choice(["div", "div", "div", "aside", "section", "ins"])
    attributes = _name(r, "ad,ads,advert,advertisement,sponsored,promo,banner-ad,ad-slot,adsbygoogle,sponsor,promotion,ad-container", "class class id")
    text = r.choice([p.sentence(2, 14), p.prose(1, 3)])
    p.put(f"<!-- {p.word()} --><{tag}{attributes}>" + r.choice([text, f"<p>{text}</p>", f"<a href='http://x/'>{text}</a>", f"<h3>{p.words(1, 5)}</h3><p>{text}</p>"]) + f"</{tag}>")


def _form(p: _Page) -> None:
    r = p.rnd
    inner = r.choice([f"<label>{p.words(1, 3)}</label><input type='text'><button>{p.word()}</button>", f"<p>{p.sentence(3, 15)}</p><input name='e'><input type='submit' value='{p.word()}'>", f"<legend>{p.words(1, 3)}</legend><select><option>{p.word()}<option>{p.word()}</select><label>{p.words(1, 4)}</label>"])
    form = f"<form action='/{p.word()}'>{inner}</form>"
    p.put(r.choice([form, f"<div{_name(r, 'newsletter,search,subscribe,login,signup,search-box,contact-form')}><h3>{p.words(1, 4)}</h3>{form}</div>"]))


def _sidebar(p: _Page) -> None:
    r = p.rnd
    tag, attributes = r.choice([("aside", ""), ("aside", _name(r, "sidebar,widget-area,rail")), ("div", _name(r, "sidebar,widget,side,rail,right-column,widget-area"))])
    p.put(f"<{tag}{attributes}><h3>{p.words(1, 4)}</h3>" + r.choice([_links(p, 2, 8), f"<p>{p.prose(1, 3)}</p>", _links(p, 2, 4) + f"<p>{p.sentence()}</p>"]) + f"</{tag}>")


def _related(p: _Page) -> None:
    r = p.rnd
    tag = r.choice(["div", "section", "aside"])
    p.put(f"<{tag}{_name(r, 'related,related-posts,more-stories,recommended,read-more,popular,trending,see-also')}><h3>{p.words(1, 4)}</h3>" + "".join(f"<{e}>{p.link(3, 10)}</{e}>" for e in [r.choice(["p", "div", "li", "h4"])] for _ in range(r.randint(2, 6))) + f"</{tag}>")


def _share(p: _Page) -> None:
    r = p.rnd
    p.put(f"<div{_name(r, 'share,social,share-buttons,social-links,tags,byline-tools,toolbar,pagination,pager')}>" + " ".join(p.link(1, 2) for _ in range(r.randint(2, 5))) + "</div>")


def _comments(p: _Page) -> None:
    r = p.rnd
    tag = r.choice(["div", "section", "ol", "aside"])
    item = "li" if tag == "ol" else r.choice(["div", "article", "li", "p"])
    p.put(f"<{tag}{_name(r, 'comments,comment-list,commentlist,discussion,replies,responses,disqus_thread,reader-comments,user-comments')}>")
    if tag != "ol" and r.random() < 0.7:
        p.put(f"<h3>{p.words(1, 3)}</h3>")
    for _ in range(r.randint(1, 6)):
        p.put(f"<{item}{r.choice(['', ' class=comment', ' class=reply'])}>" + r.choice(["", f"<b>{p.word()}</b> ", f"<span class=author>{p.word()}</span> ", f"<cite>{p.words(1, 2)}</cite>"]) + (p.prose(1, 4) if item == "p" or r.random() < 0.5 else f"<p>{p.prose(1, 4)}</p>") + f"</{item}>")
    p.put(f"</{tag}>")


def _footer(p: _Page) -> None:
    r = p.rnd
    tag, attributes = r.choice([("footer", ""), ("footer", _name(r, "site-footer,footer")), ("div", _name(r, "footer,site-footer,bottom,copyright,legal"))])
    text = r.choice([f"&copy; {p.word()}.example &middot; {p.prose(1, 3)}", f"© {p.words(1, 5)}", p.prose(1, 3), f"<p>{p.sentence()}</p>" + _links(p, 2, 6), " · ".join(p.link() for _ in range(4))])
    p.put(f"<{tag}{attributes}>{text}</{tag}>")


def _article(p: _Page) -> None:
    r = p.rnd
    kind = r.choice(["article", "article", "article", "main", "main-article", "div", "div", "plain"])
    name = _name(r, "content,article,post,entry-content,article-body,story,main,post-content,text,page-content")
    opened = {"article": [f"<article{r.choice(['', '', name])}>"], "main": [f"<main{r.choice(['', name])}>"], "main-article": ["<main>", "<article>"], "div": [f"<div{name}>"], "plain": []}[kind]
    p.put("".join(opened))
    if r.random() < 0.85:
        title = r.choice(["h1", "h1", "h1", "h2"])
        if r.random() < 0.15 and "<article>" in opened:
            p.put("<header>")
            p.content(title, p.words(2, 14).capitalize())
            p.put("</header>")
        else:
            p.content(title, p.words(2, 14).capitalize())
    middles = [_advert, _share, _related, _form, _notice]
    for k in range(r.choice([1, 2, r.randint(1, 12), r.randint(1, 12)])):
        roll = r.random()
        if roll < 0.64:
            p.content("p", r.choice([p.prose(1, 8), p.prose(1, 3), p.sentence(1, 4)]), r.choice(["", "", "", " class='lead'", " style='x'"]))
        elif roll < 0.72:
            p.content(r.choice(["h2", "h3", "h4"]), p.words(1, 8).capitalize())
        elif roll < 0.79:
            tag = r.choice(["ul", "ol"])
            p.put(f"<{tag}>")
            for _ in range(r.randint(2, 6)):
                p.content("li", r.choice([p.words(1, 8), p.sentence()]))
            p.put(f"</{tag}>")
        elif roll < 0.84:
            p.put("<blockquote>")
            p.content("p", p.prose(1, 3))
            p.put("</blockquote>")
        elif roll < 0.87:
            p.content("pre", p.words(3, 20))
        elif roll < 0.9:
            p.put("<table>")
            for _ in range(r.randint(1, 4)):
                p.put("<tr>")
                for _ in range(2):
                    p.content("td", p.words(1, 4))
                p.put("</tr>")
            p.put("</table>")
        elif roll < 0.93:
            p.put("<figure><img src='x'>")
            p.content("figcaption", p.sentence())
            p.put("</figure>")
        elif roll < 0.95 and kind != "plain":
            p.content("div", p.prose(1, 4))
        elif k:
            r.choice(middles)(p)
    if r.random() < 0.15 and kind != "plain":
        r.choice([_comments, _share, _related])(p)
    for tag in reversed([x[1:].split(">")[0].split()[0] for x in opened]):
        p.put(f"</{tag}>")


def labelled_pages(n: int = 900, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """(html, labels of its leaf blocks) of n made-up pages; the same for the same seed."""
    out = []
    for k in range(n):
        rnd = random.Random(seed * 1_000_003 + k)
        p = _Page(rnd)
        p.put(f"<!DOCTYPE html><html><head><title>{p.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        before = [x for x, share in ((_page_header, 0.6), (_navigation, 0.7), (_notice, 0.35), (_advert, 0.4), (_sidebar, 0.2), (_form, 0.15)) if rnd.random() < share]
        after = [x for x, share in ((_comments, 0.35), (_related, 0.3), (_sidebar, 0.3), (_advert, 0.3), (_form, 0.2), (_share, 0.2), (_notice, 0.2)) if rnd.random() < share]
        bare = rnd.random() < 0.12  # nothing but the article
        if bare:
            before, after = [], []
        rnd.shuffle(before)
        rnd.shuffle(after)
        wrap = rnd.random() < 0.3
        if wrap:
            p.put(f"<div{_name(rnd, 'wrapper,container,page,root')}>")
        for x in before:
            x(p)
        _article(p)
        for x in after:
            x(p)
        if not bare and rnd.random() < 0.85:
            _footer(p)
        p.put("</div>" * wrap + ("</body></html>" if rnd.random() < 0.9 else ""))
        html = "".join(p.parts)
        out.append((html, align(leaf_blocks(html), "\n\n".join(p.wanted))))
    return out
