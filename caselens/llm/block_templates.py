"""Pages of random layouts whose blocks' labels are known: what the block labeller learns from besides sampled pages.

Their words are drawn from the sampled pages' own. Whatever belongs to the article carries a mark in front,
which the reader of the labels takes off again.
"""

from __future__ import annotations

import numpy as np

#: A private-use character in front of a block of the article.
MARK = ""

# Names that pages give to their parts.
_NAMES = {
    "menu": "nav menu navbar navigation main-nav menu-primary links toolbar tabs",
    "header": "header masthead top banner site-header page-header branding logo",
    "footer": "footer site-footer bottom copyright legal colophon page-footer",
    "side": "sidebar aside secondary widget rail right-column related recommended trending popular more-stories",
    "notice": "notice cookie cookie-consent consent gdpr alert banner message popup modal overlay disclaimer",
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot adbox sponsor",
    "form": "form newsletter subscribe signup search search-form login contact-form",
    "comments": "comments comment-list comment responses discussion disqus replies reader-comments thread",
    "share": "share social share-buttons social-links tools",
    "crumbs": "breadcrumbs breadcrumb path crumbs",
    "main": "content main-content post entry entry-content article article-body story body-text text page-content single",
    "plain": "box row col wrap inner block container group section unit item cell",
}
_PHRASES = {
    "notice": ["We use cookies.", "This site uses cookies to improve your experience.", "Accept all", "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Usamos cookies.", "Read our privacy policy"],
    "ad": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Buy now"],
    "form": ["Subscribe to our newsletter", "Your email", "Send", "Search", "Log in", "Name", "Password", "Abonnieren", "Envoyer"],
    "comments": ["Comments", "Leave a reply", "Reply", "3 comments", "Kommentare", "Commentaires", "Comentarios", "Posted by", "2 hours ago"],
    "share": ["Share", "Tweet", "Facebook", "Print", "Email this"],
    "side": ["Related articles", "Most read", "Recent posts", "See also", "Tags", "Categories"],
    "footer": ["All rights reserved.", "Privacy", "Terms of use", "Contact", "Imprint", "Impressum", "© 2024"],
}


class Templates:
    def __init__(self, rng: np.random.Generator, words: list[str]):
        self.rng, self.words = rng, words or ["text"]

    def one(self, options: list[str] | tuple[str, ...]) -> str:
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.words[i] for i in self.rng.integers(len(self.words), size=self.rng.integers(low, high + 1)))

    def phrase(self, part: str, p: float = 0.5) -> str:
        return self.one(_PHRASES[part]) if part in _PHRASES and self.chance(p) else self.prose(1, 5)

    def box(self, part: str, inner: str, tags: str) -> str:
        """``inner`` in an element that says what part it is by its tag, its name, both or, now and then, neither."""
        semantic = self.chance(0.6)
        tag = self.one(tags.split()) if semantic else "div"
        named = self.chance(0.75 if semantic else 0.9)
        names = _NAMES[part] if named else _NAMES["plain"]
        attribute = "" if not named and self.chance(0.5) else f' {self.one(["class", "class", "id"])}="{self.one(names.split())}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, part: str, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="#">{self.phrase(part, 0.3)}</a>' for _ in range(self.rng.integers(low, high + 1))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else self.one([" ", " | ", "<br>"]).join(items)

    def junk(self, part: str) -> str:
        if part == "menu":
            return self.box(part, self.links(part), "nav ul menu")
        if part == "header":
            inner = f"<{(h := self.one(['h1', 'h2', 'p', 'a', 'div']))}>{self.prose(1, 6)}</{h}>" + (f"<p>{self.prose(2, 9)}</p>" if self.chance(0.4) else "")
            return self.box(part, inner + (self.junk("menu") if self.chance(0.4) else ""), "header")
        if part == "footer":
            inner = self.one([f"&copy; {self.prose(1, 12)}", f"<p>{self.phrase(part)} {self.prose(0, 14)}</p>", self.links(part)])
            return self.box(part, inner + (self.links(part) if self.chance(0.3) else ""), "footer")
        if part == "side":
            teasers = "".join(f"<p>{self.prose(4, 30)}</p>" for _ in range(self.rng.integers(0, 4)))
            return self.box(part, f"<h3>{self.phrase(part)}</h3>" + self.links(part) + teasers, "aside")
        if part == "form":
            inner = f"<label>{self.phrase(part)}</label><input><button>{self.phrase(part)}</button>" + (f"<p>{self.prose(2, 16)}</p>" if self.chance(0.4) else "")
            inner += "<select><option>" + "<option>".join(self.prose(1, 2) for _ in range(3)) + "</select>" if self.chance(0.3) else ""
            return self.box(part, inner, "form") if self.chance(0.5) else f"<form>{inner}</form>"
        if part == "comments":
            rows = "".join(self.comment() for _ in range(self.rng.integers(1, 7)))
            return self.box(part, f"<h3>{self.phrase(part)}</h3>{rows}" + (self.junk("form") if self.chance(0.3) else ""), "section")
        inner = f"{self.phrase(part)} {self.prose(0, 25)}" if self.chance(0.6) else f"<p>{self.prose(3, 40)}</p>"
        if part == "share":
            inner = self.links(part, 2, 5)
        if part == "notice" and self.chance(0.5):
            inner += f"<button>{self.phrase(part)}</button>"
        tags = {"ad": "aside div ins", "notice": "div section dialog"}.get(part, "div")
        return self.box(part, inner, tags)

    def comment(self) -> str:
        tag = self.one(["li", "div", "article", "blockquote"])
        name = f' class="{self.one(_NAMES["comments"].split())}"' if self.chance(0.5) else ""
        text = "".join(f"<p>{self.prose(2, 60)}</p>" for _ in range(self.rng.integers(1, 3)))
        return f"<{tag}{name}><b>{self.prose(1, 2)}</b> {self.one(['', self.phrase('comments')])}{text}</{tag}>"

    def article(self) -> str:
        blocks = [f"<h1>{MARK}{self.prose(2, 12)}</h1>"] if self.chance(0.85) else []
        for _ in range(self.rng.integers(1, 16) if self.chance(0.93) else self.rng.integers(16, 120)):
            kind = self.rng.random()
            if kind < 0.72:
                text = self.prose(1, 12) if self.chance(0.25) else self.prose(10, 120)
                text = f"<b>{text}<br>" if self.chance(0.1) else text
                text += f' <a href="#">{self.prose(1, 5)}</a> {self.prose(0, 9)}' if self.chance(0.15) else ""
                blocks.append(f"<{(p := self.one(['p'] * 8 + ['div']))}>{MARK}{text}</{p}>" if self.chance(0.85) else f"<p>{MARK}{text}")
            elif kind < 0.8:
                blocks.append(f"<h2>{MARK}{self.prose(1, 8)}</h2>")
            elif kind < 0.86:
                items = "".join(f"<li>{MARK}{self.prose(1, 14)}</li>" for _ in range(self.rng.integers(2, 6)))
                blocks.append(f"<{(u := self.one(['ul', 'ol']))}>{items}</{u}>")
            elif kind < 0.89:
                blocks.append(f"<blockquote>{MARK}{self.prose(5, 40)}</blockquote>")
            elif kind < 0.92:
                blocks.append(f"<pre>{MARK}{self.prose(3, 30)}</pre>")
            elif kind < 0.95:
                cells = "".join("<tr>" + "".join(f"<td>{MARK}{self.prose(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3))
                blocks.append(f"<table>{cells}</table>")
            else:
                blocks.append(self.junk(self.one(["ad", "share", "form", "side"])))
        body = "".join(blocks)
        return f"<article>{body}</article>" if self.chance(0.5) else self.box("main", body, "article main section")

    def page(self) -> str:
        before = [p for p, c in (("notice", 0.3), ("header", 0.6), ("menu", 0.7), ("ad", 0.5), ("crumbs", 0.2), ("form", 0.15), ("side", 0.15)) if self.chance(c)]
        after = [p for p, c in (("share", 0.3), ("ad", 0.2), ("comments", 0.5), ("side", 0.5), ("form", 0.2), ("menu", 0.15), ("notice", 0.1)) if self.chance(c)]
        body = "".join(map(self.junk, before)) + self.article() + "".join(self.junk(p) for p in self.rng.permutation(after)) + (self.junk("footer") if self.chance(0.8) else "")
        for _ in range(self.rng.integers(0, 3)):
            body = f'<div class="{self.one(_NAMES["plain"].split())}">{body}</div>'
        return f"<html><head><title>{self.prose(1, 6)}</title></head><body>{body}</body></html>"
