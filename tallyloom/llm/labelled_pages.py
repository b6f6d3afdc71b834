"""Labelled pages for the extraction model, made from a seed.

Every page is written with its labels: ``data-y="1"`` opens content, ``data-y="0"`` opens boilerplate, and what stands
inside belongs to it.  Layouts, order, lengths, tags, class names and unclosed tags vary; six pages in ten have no names or
names that say nothing, so that text, links, place and repeated shapes have to tell.  Words are made up.
"""

from __future__ import annotations

import random
import re

CONTENT = ["article", "main", "section", "div class='post'", "div class='content'", "div class='entry-content'", "div id='story'", "div class='article-body'", "article class='post'", "div class='text'", "div"]
BOXES = [
    "ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "sidebar", "widget", "related", "recommended",
    "share", "social", "breadcrumb", "breadcrumbs", "menu", "navbar", "nav", "navigation", "newsletter", "subscribe", "login", "signup", "search", "pagination", "pager", "tags", "legal", "copyright",
    "header", "masthead", "footer", "site-footer", "toolbar", "disclaimer", "comments", "comment", "replies", "reviews", "paywall",
]
NAME = re.compile(r" (class|id)='[^']*'")
TAGS = ["nav", "header", "footer", "aside", "form", "section", "div", "ul", "menu", "dialog"]


def page(rng: random.Random) -> str:
    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioustrnlmd") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def sentence(low: int, high: int) -> str:
        return words(low, high).capitalize() + rng.choice([".", ".", ".", "?", "!"])

    def paragraph() -> str:
        text = " ".join(sentence(2, 25) for _ in range(rng.choice([1, 1, 2, 4, 9])))
        if rng.random() < 0.2:
            text = f"<a href='/x'>{words(1, 4)}</a> " + text
        return f"<b>{text}<br>" if rng.random() < 0.1 else text

    def block() -> str:
        kind = rng.random()
        if kind < 0.7:
            return f"<p>{paragraph()}" + "</p>" * (rng.random() < 0.85)
        if kind < 0.78:
            return f"<h{rng.randint(2, 4)}>{words(2, 8)}</h{rng.randint(2, 4)}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{sentence(3, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{paragraph()}</p></blockquote>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        return rng.choice([f"<pre>{words(4, 30)}</pre>", f"<figure><figcaption>{words(3, 12)}</figcaption></figure>", f"<div>{paragraph()}</div>", f"<dl><dt>{words(1, 3)}</dt><dd>{sentence(3, 9)}</dd></dl>"])

    def links() -> str:
        return "<ul>" + "".join(f"<li><a href='/{i}'>{words(1, 3)}</a></li>" for i in range(rng.randint(2, 8))) + "</ul>"

    def form() -> str:
        return f"<form data-y='0'><label>{words(1, 4)}</label><input><select><option>{words(1, 2)}</option></select><button>{words(1, 2)}</button><p>{words(2, 12)}</p></form>"

    def comment() -> str:
        author = rng.choice([f"<b>{words(1, 2)}</b>", f"<div>{words(1, 2)}</div>", f"<span>{words(1, 2)}</span> <time>{words(1, 3)}</time>", f"<h4>{words(1, 2)}</h4>", ""])
        said = rng.choice([f"<p>{paragraph()}</p>", f"<div>{paragraph()}</div>", f"<p>{sentence(3, 25)}</p><p>{sentence(3, 25)}</p>", sentence(4, 30)])
        return author + said + rng.choice(["", "", f"<a href='#'>{words(1, 1)}</a>"])

    def comments() -> str:
        tag = rng.choice(["div", "div", "li", "article", "section"])
        name = rng.choice(["", " class='comment'", f" class='{words(1, 1)}'"])
        inner = "".join(f"<{tag}{name}>{comment()}" + (f"<{tag}{name}>{comment()}</{tag}>" if rng.random() < 0.15 else "") + f"</{tag}>" for _ in range(rng.randint(1, 5)))
        if tag == "li":
            inner = f"<ol>{inner}</ol>"
        title = rng.choice(["", f"<h2>{words(1, 2)}</h2>", f"<h3>{rng.randint(1, 99)} {words(1, 1)}</h3>"])
        outer = rng.choice(["section class='comments'", "div id='comments'", "div class='comments'", f"div class='{words(1, 1)}'", f"div id='{words(1, 1)}'", "div", "section"])
        return f"<{outer} data-y='0'>{title}{inner}</{outer.split()[0]}>"

    def notice() -> str:
        name = rng.choice(["", f" class='{words(1, 1)}'", f" id='{words(1, 1)}'", " class='notice'"])
        body = rng.choice([f"<p>{sentence(5, 22)}</p><button>{words(1, 2)}</button>", f"{sentence(5, 22)} <a href='/p'>{words(1, 2)}</a>", f"<p>{sentence(5, 18)}</p>", f"<span>{sentence(4, 14)}</span><button>{words(1, 1)}</button><button>{words(1, 2)}</button>"])
        return f"<div{name} data-y='0'>{body}</div>"

    def box() -> str:
        tag = rng.choice(TAGS)
        name = "" if tag in ("nav", "header", "footer", "aside", "form", "menu", "dialog") and rng.random() < 0.7 else f" {rng.choice(['class', 'id'])}='{rng.choice(BOXES)}'"
        body = rng.choice([links(), f"<p>{paragraph()}</p>", sentence(3, 25), f"<p>{words(1, 5)}</p>" + links(), f"<h3>{words(1, 3)}</h3>" + links(), f"<span>{sentence(4, 30)}</span>"])
        return f"<{tag}{name} data-y='0'>{body}</{tag}>"

    def boxes(low: int, high: int) -> str:
        return "".join(rng.choice([box, box, box, form, notice])() for _ in range(rng.randint(low, high)))

    opening = rng.choice(CONTENT)
    head = rng.choice(["", f"<h1>{words(2, 10)}</h1>", f"<header><h1>{words(2, 10)}</h1></header>" if opening.startswith(("article", "main")) else f"<h1>{words(2, 10)}</h1>"])
    inside = [block() for _ in range(rng.choice([1, 1, 2, 4, 8, 14]))]
    if rng.random() < 0.3:
        inside.insert(rng.randint(0, len(inside)), box())
    body = f"<{opening} data-y='1'>{head}{''.join(inside)}</{opening.split()[0]}>"
    if rng.random() < 0.35:
        body = rng.choice(["<div class='container'>{}</div>", "<main>{}</main>", "<div id='page'><div>{}</div></div>", "<div class='wrapper'>{}</div>"]).format(boxes(0, 2) + body + boxes(0, 2))
    after = comments() if rng.random() < 0.4 else ""
    if after and rng.random() < 0.3 and body.endswith(f"</{opening.split()[0]}>") and opening.startswith("article"):
        body, after = body[: -len("</article>")] + after + "</article>", ""
    out = boxes(1, 4) + body + after + boxes(1, 4)
    if rng.random() < 0.25:  # a bare page: links, then the article, and little else
        out = f"<div data-y='0'>{links()}</div>" + body + after + rng.choice(["", f"<div data-y='0'>{sentence(3, 9)}</div>", f"<div data-y='0'>{links()}</div>"])
    hidden = rng.random()
    if hidden < 0.3:  # no names at all
        out = NAME.sub("", out)
    elif hidden < 0.6:  # names that say nothing
        out = NAME.sub(lambda m: f" {m[1]}='{words(1, 1)}'", out)
    return f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{}}</style></head><body data-y='0'>{out}</body></html>"


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
