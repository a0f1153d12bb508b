"""Text functions as Column expressions; HTML to text is the one UDF."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .once import bind

#: Latin letters with marks and what they are without (fixed values).
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: ASCII characters, without capitals, that matching does not tell from spaces.
OTHER_ASCII = "".join(c for c in map(chr, range(128)) if not re.match(r"[a-zA-Z0-9+\-.'/ ]", c))


def collapse_whitespace(c: Column) -> Column:
    # a single space is what it becomes, so it is passed over
    return F.trim(F.regexp_replace(c, r"[\s\u00a0]{2,}|[\t\n\u000b\f\r\u00a0]", " "))


def strip_marks(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def normalize_match(c: Column) -> Column:
    """Lower case without marks; only a-z, digits and ``+ - . ' /`` stay, other runs become one space."""
    # plain ASCII needs neither marks nor a pattern, which costs several times as much as a look at each character
    ascii_ = lambda t: F.translate(F.lower(t), OTHER_ASCII, " " * len(OTHER_ASCII))
    other = lambda t: F.regexp_replace(F.translate(F.lower(strip_marks(t)), "‘’", "''"), r"[^a-z0-9+\-.'/ ]", " ")
    plain = bind(c, lambda t: F.when(F.octet_length(t) == F.length(t), ascii_(t)).otherwise(other(t)))
    return F.trim(F.regexp_replace(plain, "  +", " "))


def split_segments(c: Column) -> Column:
    """Sentences: text parted after ``.!?;•|`` with white space, or at newlines; collapsed, empty ones dropped."""
    marked = F.regexp_replace(c, r"([.!?;•|])[ \t\r\n]+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda s: collapse_whitespace(s)), lambda s: s != "")


def admissible(segment: Column, least: int = 12, most: int = 1200) -> Column:
    return F.length(segment).between(least, most)


def truncate(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def content_tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words of three letters or more that are not stop words, in order, with repeats."""
    return F.filter(F.split(normalize_match(c), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*stop) if stop else F.length(w) >= 3)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_marks(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def clean_page_text(c: Column) -> Column:
    """Without zero-width characters; single newlines become spaces, blank lines stay as one."""
    text = F.regexp_replace(c, "[​‌‍﻿]", "")
    text = F.regexp_replace(F.regexp_replace(text, " ", " "), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    text = F.regexp_replace(text, r"\n{2,}", "\u0001")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\n", " "), "\u0001", "\n\n"))


#: What is left out of a page, what may hold its content (the first that has enough counts), and elements that begin a paragraph:
#: tags, ``.class``, ``#id`` and ``attribute=value`` (fixed values).
HIDDEN = (
    "script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed", "form", "nav", "aside", "footer", "header",
    "role=navigation", "role=banner", "role=contentinfo", "aria-hidden=true",
    ".cookie", ".cookies", "#cookie", ".cookie-banner", ".newsletter", ".breadcrumb", ".social", ".advertisement", ".ads", ".sidebar", ".menu",
)
CONTENT = (
    "main", "article", "role=main", "#content", "#main", ".product-description", ".product-details", ".product__description", ".specifications",
    ".features", ".entry-content", ".post-content", ".rte",
)
BLOCK = frozenset("p div li tr h1 h2 h3 h4 h5 h6 br section article ul ol table td th dd dt".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENOUGH = 400


def _marks(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
    """What selectors say that an element meets."""
    of = dict(attrs)
    marks = {tag, *(f".{c}" for c in (of.get("class") or "").split())}
    marks |= {f"{name}={of[name]}" for name in ("role", "aria-hidden") if of.get(name)}
    return marks | {f"#{of['id']}"} if of.get("id") else marks


class _TextOf(HTMLParser):
    """Pieces of visible text, and where among them the body and the parts that may hold the content begin and end."""

    WANTED = frozenset((*CONTENT, "body"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces, self.open, self.names, self.hidden, self.spans = [], [], Counter(), 0, {}

    def handle_starttag(self, tag, attrs):
        marks = _marks(tag, attrs)
        hides = not marks.isdisjoint(HIDDEN)
        if tag in BLOCK and not self.hidden and not hides:
            self.pieces.append("\n\n")
        if tag not in VOID:
            seen = not self.hidden and not hides
            begun = [m for m in self.WANTED & marks if m not in self.spans] if seen else []
            self.spans.update((m, [len(self.pieces), None]) for m in begun)
            self.open.append((tag, hides, begun))
            self.names[tag] += 1
            self.hidden += hides

    def handle_endtag(self, tag):
        name = None
        while self.names[tag] and name != tag:
            name, hides, begun = self.open.pop()
            self.names[name] -= 1
            self.hidden -= hides
            for mark in begun:
                self.spans[mark][1] = len(self.pieces)

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)

    def between(self, mark: str) -> str:
        first, last = self.spans.get(mark, (0, 0))
        return "".join(self.pieces[first:last])


def html_text(html: str | None) -> str:
    """Visible text of the first part that may hold the content and has over 400 characters, else of the body or the page."""
    if not html:
        return ""
    parser = _TextOf()
    parser.feed(html)
    parser.close()
    body = parser.between("body")
    text = next((t for t in map(parser.between, CONTENT) if len(t.strip()) > ENOUGH), body if body.strip() else "".join(parser.pieces))
    return re.sub(r"\s*\n\s*\n\s*", "\n\n", re.sub(r"[ \t\r\f\v]+", " ", text)).strip()


#: Pages go to Python by 100 (``spark.sql.execution.python.udf.maxRecordsPerBatch``): an Arrow batch holds 10,000, which several times over fill the memory of a worker.
html_to_text = F.udf(html_text, StringType(), useArrow=False)
