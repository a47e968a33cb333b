"""Labelled training pages, made from rules.

Each page nests an article among menus, headers, footers, sidebars, notices,
adverts, forms and reader comments under names that pages commonly use.  The article
is marked ``data-keep``; what stands inside it without being part of it has the name
``data-drop``.  The words are random, so nothing is learned about them.
"""

from __future__ import annotations

import random

MENU = "nav menu navbar navigation topnav main-nav site-nav breadcrumb breadcrumbs pagination pager tabs toc skip-link links"
HEADER = "header site-header masthead topbar page-header banner branding logo top"
FOOTER = "footer site-footer page-footer bottom copyright colophon legal credits"
SIDE = "sidebar side aside widget widgets rail right-column secondary related related-posts recommended trending popular tags tagcloud author-box archive"
NOTICE = "notice cookie cookies cookie-banner consent gdpr alert popup modal overlay message warning paywall toast announcement disclaimer"
ADVERT = "ad ads advert advertisement adbox ad-slot sponsored sponsor promo promotion banner-ad google-ad outbrain taboola"
FORM = "newsletter subscribe signup login search search-form contact-form subscription register"
COMMENT = "comments comment comment-list discussion replies reply disqus responses reader-comments user-comments thread"
SHARE = "share sharing social social-links share-buttons follow toolbar actions meta byline print rating"
MAIN = "article content post entry story main body text article-body post-content entry-content story-body main-content page-content prose article-content"
PLAIN = "container wrapper row col column inner outer wrap grid box section block clearfix layout page site app root"

SYLLABLES = "ba ko ri tem los ven da mu shi per on al ti gra fe no ul est ir ma".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r, low, high):
    return " ".join(_word(r) for _ in range(r.randint(low, high)))


def _sentence(r):
    return _words(r, 4, 18).capitalize() + r.choice([".", ".", ".", "?", "!"])


def _prose(r, low=1, high=6):
    if r.random() < 0.08:  # a run of words without a full stop
        return _words(r, 3, 90)
    out = []
    for _ in range(r.randint(low, high)):
        s = _sentence(r)
        kind = r.random()
        if kind < 0.12:
            s = f'<a href="#">{_words(r, 1, 4)}</a> {s}'
        elif kind < 0.25:
            tag = r.choice(["b", "i", "em", "strong", "code", "span"])
            s = f"<{tag}>{_words(r, 1, 5)}</{tag}> {s}"
        out.append(s)
    return " ".join(out)


def _links(r, low=2, high=9):
    n = r.randint(low, high)
    items = [f'<a href="/{_word(r)}">{_words(r, 1, 3)}</a>' for _ in range(n)]
    if r.random() < 0.6:
        close = "</li>" if r.random() < 0.8 else ""
        return "<ul>" + "".join(f"<li>{i}{close}" for i in items) + "</ul>"
    return r.choice([" | ", " ", "<br>"]).join(items)


def _named(r, tag, names, inner, extra=""):
    attr = ""
    if names and r.random() < 0.9:
        attr = f' {r.choice(["class", "class", "id"])}="{r.choice(names.split())}{extra}"'
    elif extra:
        attr = f' class="{extra.strip()}"'
    return f"<{tag}{attr}>{inner}</{tag}>"


def _comments(r, drop=""):
    one = lambda: _named(r, r.choice(["div", "li", "article", "p"]), "comment reply comment-body", f"<p>{_prose(r, 1, 4)}</p>")
    inner = f"<h3>{_words(r, 1, 3)}</h3>" * (r.random() < 0.7) + "".join(one() for _ in range(r.randint(1, 5)))
    return f'<{"section"} {r.choice(["class", "id"])}="{r.choice(COMMENT.split())}{drop}">{inner}</section>' if r.random() < 0.5 else f'<div {r.choice(["class", "id"])}="{r.choice(COMMENT.split())}{drop}">{inner}</div>'


def _form(r, drop=""):
    inner = f"<label>{_words(r, 1, 3)}</label><input type=text><button>{_words(r, 1, 2)}</button>"
    if r.random() < 0.4:
        inner = f"<p>{_prose(r, 1, 2)}</p>" + inner
    if r.random() < 0.3:
        inner += "<select>" + "".join(f"<option>{_word(r)}" for _ in range(3)) + "</select>"
    return _named(r, "form", FORM if r.random() < 0.6 else "", inner, drop)


def _junk(r, where, drop=""):
    kind = r.choice(where)
    div = lambda *tags: r.choice(["div", "div", *tags])
    if kind == "menu":
        return _named(r, div("nav", "nav", "menu"), MENU, _links(r), drop)
    if kind == "header":
        return _named(r, div("header", "header"), HEADER, f"<a href=/>{_words(r, 1, 3)}</a>" + (_links(r) if r.random() < 0.5 else f"<p>{_words(r, 2, 8)}</p>"), drop)
    if kind == "footer":
        return _named(r, div("footer", "footer"), FOOTER, r.choice([f"&copy; {_words(r, 1, 3)} &middot; {_prose(r, 1, 2)}", f"<p>{_prose(r, 1, 3)}</p>", _links(r)]), drop)
    if kind == "side":
        return _named(r, div("aside", "aside"), SIDE, f"<h3>{_words(r, 1, 4)}</h3>" + r.choice([_links(r), f"<p>{_prose(r, 1, 3)}</p>"]), drop)
    if kind == "notice":
        return _named(r, div("section"), NOTICE, r.choice([_prose(r, 1, 3), f"<p>{_prose(r, 1, 3)}</p>"]) + f"<button>{_words(r, 1, 2)}</button>" * (r.random() < 0.5), drop)
    if kind == "ad":
        return _named(r, div("aside", "ins", "section"), ADVERT, r.choice([_prose(r, 1, 4), f"<p>{_prose(r, 1, 2)}</p>", f'<a href="#">{_words(r, 2, 6)}</a>']), drop)
    if kind == "form":
        return _form(r, drop)
    if kind == "comments":
        return _comments(r, drop)
    return _named(r, div("ul"), SHARE, _links(r, 2, 5), drop)


def _article(r) -> str:
    parts = []
    head = f"<h1>{_words(r, 2, 10)}</h1>"
    if r.random() < 0.8:
        parts.append(f"<header>{head}</header>" if r.random() < 0.2 else head)
    style = r.random()
    for _ in range(1 if r.random() < 0.1 else r.randint(1, 9)):
        k = r.random()
        if k < 0.7:
            if style < 0.12:
                parts.append(f"<div>{_prose(r)}</div>")
            elif style < 0.2:
                parts.append(f"{_prose(r)}<br><br>")
            elif style < 0.4:
                parts.append(f"<p>{'<b>' * (r.random() < 0.3)}{_prose(r)}{'<br>' * (r.random() < 0.3)}")
            else:
                parts.append(f"<p>{_prose(r)}</p>")
        elif k < 0.76:
            parts.append(f"<h{r.choice([2, 3, 4])}>{_words(r, 1, 6)}</h2>")
        elif k < 0.82:
            parts.append("<ul>" + "".join(f"<li>{_sentence(r)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif k < 0.86:
            parts.append(f"<blockquote><p>{_prose(r, 1, 2)}</p></blockquote>")
        elif k < 0.89:
            parts.append(f"<figure><img src=x><figcaption>{_sentence(r)}</figcaption></figure>")
        elif k < 0.92:
            parts.append(f"<pre>{_words(r, 3, 12)}</pre>")
        elif k < 0.93:
            parts.append("<ul>" + "".join(f'<li><a href="/{_word(r)}">{_words(r, 1, 6)}</a>{"</li>" * (r.random() < 0.8)}' for _ in range(r.randint(1, 5))) + "</ul>")
        elif k < 0.95:
            parts.append("<table>" + "".join(f"<tr><td>{_words(r, 1, 4)}</td><td>{_words(r, 1, 4)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            parts.append(f"<p>{_words(r, 1, 3)}</p>")
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        parts.insert(r.randint(0, len(parts)), _junk(r, ["ad", "ad", "share", "side", "form", "notice", "menu"], " data-drop"))
    if r.random() < 0.12:
        parts.append(_junk(r, ["comments"], " data-drop"))
    if r.random() < 0.08:
        parts.append(_junk(r, ["footer"], " data-drop"))
    return "".join(parts)


def page(seed: int) -> str:
    """One labelled page."""
    r = random.Random(seed)
    tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
    named = tag in ("div", "section", "td") or r.random() < 0.4
    attr = f' {r.choice(["class", "id"])}="{r.choice(MAIN.split())}"' if named and r.random() < 0.93 else ""
    body = f"<{tag}{attr} data-keep>{_article(r)}</{tag}>"
    if tag == "td":
        side = _junk(r, ["menu", "side", "ad"])
        body = f"<table><tr><td>{side}</td>{body}</tr></table>" if r.random() < 0.5 else f"<table><tr>{body}</tr></table>"
    if r.random() < 0.3:
        body += _junk(r, ["comments"])
    if r.random() < 0.3:
        body = _junk(r, ["menu", "share", "ad"]) + body
    for _ in range(r.choice([0, 0, 1, 1, 2])):
        if r.random() < 0.4:
            body += _junk(r, ["side", "ad", "comments", "share"])
        body = _named(r, r.choice(["div", "div", "main", "section"]), PLAIN + " " + MAIN if r.random() < 0.3 else PLAIN, body)
    before = [_junk(r, ["menu", "menu", "header", "notice", "ad", "form"]) for _ in range(r.randint(0, 4))]
    after = [_junk(r, ["footer", "footer", "side", "ad", "comments", "form", "menu", "notice"]) for _ in range(r.randint(0, 4))]
    gap = r.choice(["", "\n", "\n  "])
    if r.random() < 0.1:  # a fragment: no head, nothing around
        return body
    return f"<!DOCTYPE html><html><head><title>{_words(r, 1, 6)}</title><style>p{{}}</style></head><body>{gap.join([*before, body, *after])}</body></html>"
