"""Made-up pages with a label for every block, from which the block labeller learns.

Nothing is read from any corpus: words are invented from syllables, layouts are drawn from the usual ways
to mark up articles and what surrounds them, some with telling tags and names, some with neither.
"""

from __future__ import annotations

import numpy as np

# How pages name their parts.
ARTICLES = ["<article>", "<article class='post'>", "<main>", "<main><article>", "<div class='content'>", "<div class='article-body'>", "<div id='content'><div class='entry'>", "<section class='story'>",
            "<div class='post-content'>", "<div itemprop='articleBody' class='text'>", "<div id='main'><article class='hentry'>", "<div class='article'>", "<section class='article'>", "<body-part>"]
MENUS = ["<nav>", "<nav class='menu'>", "<div class='nav'>", "<div id='menu'>", "<ul class='navbar'>", "<div class='breadcrumbs'>", "<div class='navigation'>", "<div role='navigation'>", "<div class='topbar links'>"]
HEADERS = ["<header>", "<div class='header'>", "<div id='masthead'>", "<header class='site-header'>", "<div class='banner'>", "<div class='site-title logo'>"]
FOOTERS = ["<footer>", "<div class='footer'>", "<div id='footer'>", "<footer class='site-footer'>", "<div class='copyright'>", "<div class='bottom legal'>"]
SIDES = ["<aside>", "<div class='sidebar'>", "<div id='sidebar'>", "<aside class='related'>", "<div class='related'>", "<div class='widget'>", "<section class='recommended'>", "<div class='most-read popular'>", "<div class='side'>"]
NOTICES = ["<div class='notice'>", "<div class='cookie-banner'>", "<div id='cookies'>", "<div class='alert'>", "<div class='newsletter'>", "<div class='subscribe'>", "<div role='alert'>", "<div class='paywall message'>", "<div class='disclaimer'>", "<dialog>", "<div class='popup'>", "<div class='consent gdpr'>", "<p class='notice'>"]
ADVERTS = ["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div id='ad-1'>", "<div class='advertisement'>", "<aside class='ad'>", "<div class='sponsored'>", "<div class='promo'>", "<section class='ad-slot'>", "<p class='ad'>", "<div class='sponsor banner'>"]
FORMS = ["<form>", "<form class='search'>", "<form id='login'>", "<form action='/s' class='signup'>", "<fieldset>"]
COMMENTS = ["<section class='comments'>", "<div id='comments'>", "<ol class='comment-list'>", "<div class='comment'>", "<div id='disqus_thread'>", "<div class='reader-comments'>", "<section id='responses'>", "<div class='replies'>", "<ul class='discussion'>", "<article class='comment'>"]
SHARES = ["<div class='share'>", "<div class='social'>", "<ul class='tags'>", "<div class='toolbar'>", "<div class='share-buttons'>"]
INSIDE = [("<math><mi>", "</mi></math>"), ("<object>", "</object>"), ("<svg><title>", "</title></svg>"), ("<noscript>", "</noscript>")]
BOILER_WORDS = "home menu login register search subscribe newsletter privacy terms cookies accept contact about share tweet comment reply comments advertisement sponsored copyright rights reserved related more read next previous sign up follow us email password submit close".split()


class _Writer:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng, self.html, self.labels = rng, [], []
        self.syllables = ["".join(rng.choice(list("aeioubcdfghklmnprstvéèüñó"), rng.integers(1, 4))) for _ in range(40)]
        self.opaque = rng.random() < 0.3
        self.junk = str(rng.choice(["", "", "", "", "###", "!!", " |", "&amp;&amp;", "***"]))

    def words(self, n: int, boiler: float = 0.0) -> str:
        r = self.rng
        sizes, told = r.integers(1, 4, n), r.random(n) < boiler
        syllables = iter(r.integers(0, len(self.syllables), sizes.sum()).tolist())
        return " ".join(BOILER_WORDS[r.integers(len(BOILER_WORDS))] if common else "".join(self.syllables[next(syllables)] for _ in range(size)) for size, common in zip(sizes.tolist(), told.tolist(), strict=True))

    def prose(self, n: int) -> str:
        text = self.words(n) if self.rng.random() < 0.93 else " ".join([self.words(1)] * n)
        if self.junk:
            text = text.replace(" ", self.junk + " ")
        if self.rng.random() < 0.2:
            at = text.find(" ")
            text = f"{text[: at + 1]}<b>{text[at + 1 :]}</b>" if at > 0 else f"<i>{text}</i>"
        elif self.rng.random() < 0.02:
            start, end = INSIDE[self.rng.integers(len(INSIDE))]
            text += f" {start}{self.words(2)}{end}"
        return text.capitalize() + str(self.rng.choice([".", ".", ".", "", "!", "?"]))

    def opened(self, choices: list[str]) -> tuple[str, str]:
        if self.opaque:
            name = "".join(self.rng.choice(list("abcdefghijkmnpqrstuvwxyz"), 5))
            return f"<div class='{name}'>", "</div>"
        start = str(self.rng.choice(choices))
        tags = [x.split()[0].rstrip(">") for x in start.split("<")[1:]]
        return start, "".join(f"</{t}>" for t in reversed(tags))

    def block(self, tag: str, text: str, label: int) -> None:
        close = "" if tag in ("p", "li") and self.rng.random() < 0.1 else f"</{tag}>"
        self.html.append(f"<{tag}>{text}{close}")
        self.labels.append(label)

    def links(self, n: int, listed: bool) -> None:
        if listed:
            self.html.append("<ul>")
        for _ in range(n):
            self.block("li" if listed else str(self.rng.choice(["div", "p"])), f"<a href='/x'>{self.words(self.rng.integers(1, 5), 0.25)}</a>", 0)
        if listed:
            self.html.append("</ul>")

    def outside(self, choices: list[str]) -> None:
        """One part around the article, in one of its usual shapes."""
        r = self.rng
        start, end = self.opened(choices)
        self.html.append(start)
        if choices is MENUS or choices is SHARES:
            self.links(r.integers(2, 9), r.random() < 0.7)
        elif choices is FORMS:
            for _ in range(r.integers(1, 4)):
                self.html.append(f"<label>{self.words(2, 0.6)}</label><input name='a'>")
                self.html.append(f"<button>{self.words(r.integers(1, 3), 0.7)}</button>")
                self.labels += [0, 0]
            if start.startswith("<fieldset") or r.random() < 0.3:
                self.block("p", self.prose(r.integers(3, 15)), 0)
        elif choices is COMMENTS:
            for _ in range(r.integers(1, 7)):
                if r.random() < 0.5:
                    self.block("div" if "<ol" not in start else "li", self.words(r.integers(1, 4), 0.2), 0)
                self.block("p", self.prose(r.integers(2, 60)), 0)
        elif r.random() < 0.5 or start.startswith("<p"):
            self.html.append(self.prose(r.integers(3, 30)) if r.random() < 0.7 else "&copy; " + self.words(r.integers(2, 9), 0.4))
            self.labels.append(0)
        else:
            if r.random() < 0.5:
                self.block(str(r.choice(["h1", "h2", "h3", "h4"])), self.words(r.integers(1, 6), 0.3), 0)
            if r.random() < 0.4:
                self.links(r.integers(1, 6), r.random() < 0.6)
            else:
                for _ in range(r.integers(1, 4)):
                    self.block(str(r.choice(["p", "div", "p"])), self.prose(r.integers(2, 40)), 0)
        self.html.append(end)

    def link_line(self, n: int) -> None:
        """Links one behind the other in one block."""
        between = str(self.rng.choice([" ", "<br>", " | "]))
        self.html.append(f"<div>{between.join(f'<a href=/x>{self.words(self.rng.integers(1, 4), 0.25)}</a>' for _ in range(n))}</div>")
        self.labels.append(0)

    def legal_line(self) -> str:
        mark = str(self.rng.choice(["&copy; ", "Copyright ", "Copyright &copy; "]))
        rest = str(self.rng.choice(["", ". All rights reserved.", " | Privacy | Terms"]))
        return f"{mark}{self.rng.integers(1995, 2030)} {self.words(self.rng.integers(1, 4)).title()}{rest}"

    def article(self, wrapped: bool = True) -> None:
        r = self.rng
        start, end = self.opened([a for a in ARTICLES if "body-part" not in a]) if wrapped else ("", "")
        self.html.append(start)
        if r.random() < 0.85:
            heading = f"<header><h1>{self.words(r.integers(2, 12))}</h1></header>" if r.random() < 0.1 else f"<h1>{self.words(r.integers(2, 12))}</h1>"
            self.html.append(heading)
            self.labels.append(1)
        paragraph = "div" if r.random() < 0.1 else "p"
        for _ in range(int(r.choice([1, 2, 3, 5, 8, 13, 21]))):
            kind = r.random()
            if kind < 0.72:
                self.block(paragraph, self.prose(int(r.choice([1, 2, 4, 9, 20, 40, 90]))), 1)
            elif kind < 0.78:
                self.block(str(r.choice(["h2", "h3"])), self.words(r.integers(1, 7)), 1)
            elif kind < 0.83:
                self.html.append("<ul>")
                for _ in range(r.integers(1, 5)):
                    self.block("li", self.prose(r.integers(1, 25)), 1)
                self.html.append("</ul>")
            elif kind < 0.87:
                self.block(str(r.choice(["blockquote", "pre", "div", "div"])), self.prose(r.integers(3, 30)), 1)
            elif kind < 0.89:
                self.html.append("<table><tr>")
                for _ in range(4):
                    self.block("td", self.words(r.integers(1, 4)), 1)
                self.html.append("</tr></table>")
            elif kind < 0.91:
                self.html.append(f"<figure><img src='a'><figcaption>{self.prose(r.integers(2, 14))}</figcaption></figure>")
                self.labels.append(1)
            elif not self.opaque:
                which = [ADVERTS, NOTICES, SHARES, SIDES, FORMS][r.integers(0, 5)]
                self.outside(which)
        if not self.opaque and r.random() < 0.1:
            self.outside(COMMENTS)
        self.html.append(end)


def _plain(w: _Writer) -> None:
    """Hardly anything around the article, and no name or tag that tells: a line of links, a line of copyright or neither."""
    r = w.rng
    w.opaque = True
    if r.random() < 0.4:
        start, end = w.opened(MENUS)
        w.html.append(start)
        if r.random() < 0.5:
            w.links(r.integers(2, 7), r.random() < 0.5)
        else:
            w.link_line(r.integers(2, 7))
        w.html.append(end)
    w.article()
    if r.random() < 0.5:
        start, end = w.opened(FOOTERS)
        w.html.append(f"{start}{w.legal_line()}{end}")
        w.labels.append(0)


def _tabled(w: _Writer) -> None:
    """The page as a table: links in a cell or a row, the article in a cell, a copyright line in the last row."""
    r = w.rng
    cell = "<td>" if r.random() < 0.5 else f"<td width='{r.integers(80, 600)}' valign='top'>"
    w.html.append("<table><tr>" if r.random() < 0.5 else "<center><table border='0'><tbody><tr>")
    if r.random() < 0.3:
        w.html.append(f"<td colspan='2'><h1>{w.words(r.integers(1, 4))}</h1></td></tr><tr>")
        w.labels.append(0)
    menu = r.random()
    if menu < 0.8:
        w.html.append(cell)
        if r.random() < 0.5:
            w.link_line(r.integers(2, 9))
        else:
            w.links(r.integers(2, 9), r.random() < 0.5)
        w.html.append("</td>" if menu < 0.5 else "</td></tr><tr>")
    w.html.append(cell)
    w.article(wrapped=r.random() < 0.3)
    w.html.append("</td>")
    if r.random() < 0.2:
        w.html.append(cell)
        w.links(r.integers(1, 6), False)
        w.html.append("</td>")
    w.html.append("</tr>")
    if r.random() < 0.8:
        w.html.append(f"<tr><td colspan='2'>{w.legal_line()}</td></tr>")
        w.labels.append(0)
    w.html.append("</table>")


def page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """(html, label of each block in page order: 1 for the article's)."""
    w = _Writer(rng)
    w.html.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>")
    layout = rng.random()
    if layout < 0.1:
        _plain(w)
    elif layout < 0.2:
        _tabled(w)
    else:
        _parts(w)
    w.html.append("</body></html>")
    return "".join(w.html), w.labels


def _parts(w: _Writer) -> None:
    """Any of the usual parts before the article, and any behind it."""
    rng = w.rng
    before = [HEADERS, MENUS, NOTICES, ADVERTS, FORMS, SHARES, SIDES]
    after = [COMMENTS, SIDES, SHARES, FORMS, ADVERTS, NOTICES, MENUS]
    for part in before:
        if rng.random() < 0.35:
            w.outside(part)
    if rng.random() < 0.97:
        w.article()
    for part in after:
        if rng.random() < 0.35:
            w.outside(part)
    if rng.random() < 0.8:
        w.outside(FOOTERS)
