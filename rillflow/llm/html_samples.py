"""Labelled pages for training: drawn from a seed, of many layouts.

Each text of a page begins with a private mark that says whether it belongs to
the article; training takes the marks off before it looks at anything.
"""

from __future__ import annotations

import random

MAIN, OTHER = "\ue000", "\ue001"
PAGES, SEED = 400, 20  # how many are drawn: the bound of the training sample

SYLLABLES = "ta re mi so lu ka ne vo di pa el or un est ing ter ble con que ist ard mon ly ve ch sa".split()
CONTAINERS = ('<article>', '<article class="post">', '<main>', '<main><article>', '<div class="content">', '<div class="entry-content">', '<div id="article-body">', '<section class="story">', '<div class="post-body">', '<div role="main">', '<div class="text">')


def words(r: random.Random, low: int, high: int) -> str:
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))


def sentences(r: random.Random, low: int, high: int) -> str:
    return " ".join(words(r, 3, 18).capitalize() + r.choice(".....!?") for _ in range(r.randint(low, high)))


def closing(tags: str) -> str:
    return "".join(f"</{t.split()[0].rstrip('>')}>" for t in reversed([x for x in tags.split("<") if x]))


def inline(r: random.Random, text: str) -> str:
    parts = text.split(" ")
    for _ in range(r.choice((0, 0, 1, 2))):
        i = r.randrange(len(parts))
        parts[i] = r.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<b>{}", "<i>{}</i>", "{}<br>")).format(parts[i])
    return " ".join(parts)


def links(r: random.Random, wrap: str, n: int) -> str:
    items = "".join(f'<li><a href="/{i}">{OTHER}{words(r, 1, 3)}</a></li>' for i in range(n))
    return f"{wrap}<ul>{items}</ul>{closing(wrap)}"


def article(r: random.Random) -> str:
    out = []
    if r.random() < 0.8:
        out.append(f"<h1>{MAIN}{words(r, 2, 12).capitalize()}</h1>")
    for _ in range(r.choice((1, 1, 2, 3, 5, 8, 15))):
        kind = r.random()
        if kind < 0.08:
            out.append(f"<h2>{MAIN}{words(r, 1, 6)}</h2>")
        elif kind < 0.14:
            out.append("<ul>" + "".join(f"<li>{MAIN}{words(r, 2, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.18:
            out.append(f"<blockquote><p>{MAIN}{sentences(r, 1, 2)}</p></blockquote>")
        elif kind < 0.21:
            out.append("<table><tr>" + "".join(f"<td>{MAIN}{words(r, 1, 4)}</td>" for _ in range(3)) + "</tr></table>")
        elif kind < 0.23:
            out.append(f"<pre>{MAIN}{words(r, 5, 15)}</pre>")
        elif kind < 0.33:
            out.append(f"<p>{MAIN}{words(r, 1, 3).capitalize()}.</p>")
        elif kind < 0.4:
            out.append(f"<p><b>{MAIN}{sentences(r, 1, 3)}<br>")  # left open, as many pages have it
        else:
            out.append(f"<p>{MAIN}{inline(r, sentences(r, 1, 8))}</p>")
    return "".join(out)


def advert(r: random.Random) -> str:
    box = r.choice(('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="sponsored promo">', '<aside class="ad-slot">', '<div id="banner-ad">', '<section class="sponsor">'))
    inner = sentences(r, 1, 3)
    return box + (f"{OTHER}{inner}" if r.random() < 0.6 else f"<p>{OTHER}{inner}</p>") + closing(box)


def notice(r: random.Random) -> str:
    box = r.choice(('<div class="notice">', '<div class="cookie-notice">', '<div id="cookie-consent">', '<div role="alert">', '<div class="alert message">', '<section class="newsletter subscribe">', '<div class="gdpr popup">'))
    return f"{box}<p>{OTHER}{sentences(r, 1, 2)}</p><button>{OTHER}{words(r, 1, 2)}</button>{closing(box)}"


def sidebar(r: random.Random) -> str:
    box = r.choice(("<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div id="sidebar">', '<div class="related widget">', '<section class="widget">', '<div class="rail trending">'))
    body = f"<h3>{OTHER}{words(r, 1, 4)}</h3>" + (links(r, "<div>", r.randint(2, 6)) if r.random() < 0.6 else f"<p>{OTHER}{sentences(r, 1, 3)}</p>")
    return box + body + closing(box)


def form(r: random.Random) -> str:
    return f'<form action="/s"><label>{OTHER}{words(r, 1, 3)}</label><input name="q"><select><option>{OTHER}{words(r, 1, 2)}<option>{OTHER}{words(r, 1, 2)}</select><p>{OTHER}{sentences(r, 1, 2)}</p><button>{OTHER}{words(r, 1, 2)}</button></form>'


def comments(r: random.Random) -> str:
    box = r.choice(('<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<section id="disqus-thread" class="discussion">', '<div class="responses replies">'))
    each = r.choice(('<div class="comment"><p>{}</p></div>', '<li class="comment">{}</li>', '<div class="reply"><span>{}</span></div>', "<p>{}</p>", "<article><p>{}</p></article>"))
    return f"{box}<h2>{OTHER}{words(r, 1, 3)}</h2>" + "".join(each.format(OTHER + sentences(r, 1, 4)) for _ in range(r.randint(1, 5))) + closing(box)


def page(r: random.Random) -> str:
    nav = r.choice(("<nav>", '<nav class="menu">', '<div class="nav">', '<div id="menu">', '<div class="breadcrumb">', '<div role="navigation">', "<header><nav>"))
    top = []
    if r.random() < 0.4:
        box = r.choice(("<header>", '<div class="header">', '<div id="masthead" class="site-header">', '<div role="banner">'))
        top.append(f"{box}<p>{OTHER}{words(r, 1, 8)}</p>{closing(box)}")
    if r.random() < 0.85:
        top.append(links(r, nav, r.randint(2, 8)))
    for make, share in ((notice, 0.25), (advert, 0.5), (form, 0.15), (sidebar, 0.2)):
        if r.random() < share:
            top.append(make(r))
    main = r.choice(CONTAINERS)
    body = article(r)
    if r.random() < 0.25:
        body += advert(r)
        body += f"<p>{MAIN}{sentences(r, 2, 5)}</p>"
    inside = comments(r) if r.random() < 0.15 else ""
    low = []
    for make, share in ((sidebar, 0.3), (comments, 0.3), (advert, 0.25), (form, 0.2), (notice, 0.1)):
        if r.random() < share:
            low.append(make(r))
    r.shuffle(low)
    foot = r.choice(("<footer>", '<footer class="site-footer">', '<div class="footer">', '<div id="footer">', '<div role="contentinfo">'))
    low.append(f"{foot}{OTHER}{r.choice(('&copy; ', '', 'Copyright ', '&copy; example.com &middot; '))}{sentences(r, 1, 2)}{links(r, '<div>', 3) if r.random() < 0.4 else ''}{closing(foot)}")
    return f"<!DOCTYPE html><html><head><title>{words(r, 2, 8)}</title><style>p{{}}</style><script>var a = '<p>';</script></head><body>{''.join(top)}<!-- x -->{main}{body}{inside}{closing(main)}{''.join(low)}</body></html>"


def pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
