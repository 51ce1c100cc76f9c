"""What a page shows of itself where it has no metadata: candidates for author, minutes, tags and contents, found in its tree.

The rules only collect, in the order in which they count; which candidate holds is decided by columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions import text as tx

#: How pages mark authors, tags, contents, responses and reading times.
AUTHOR_CLASS = re.compile(r"author-name|authorName|author__name|byline-name", re.I)
AUTHOR_LINK = re.compile(r"/author/|/team/", re.I)
BY = re.compile(r"^(by|written by|author:?)\s*", re.I)
PORTRAIT = re.compile(r"Photo|Avatar|Author", re.I)
NO_PORTRAIT_NAME = re.compile(r"^(Photo|Avatar|Image|By|Written)", re.I)
NO_ALT_NAME = re.compile(r"^(Photo|Image|Avatar|Logo|Icon|Cover)", re.I)
FOLLOWERS = re.compile(r"\d+[KkMm]?\s*[Ff]ollowers")
MINUTES_READ = re.compile(r"\b(\d+)\s*min(?:ute)?s?\s*read\b", re.I)
MINUTES_ALONE = re.compile(r"^(\d+)\s*min(?:ute)?s?\.?$", re.I)
TAG_LINK = re.compile(r"/(topic|tag|category|subject|subjects)/", re.I)
TAG_CLASS = re.compile(r"tag|topic|categor|subject", re.I)
TAG_LABEL = re.compile(r"^(topics?|tags?|categories?|subjects?):\s*$", re.I)
QUERY_LINK = re.compile(r"\?query=", re.I)
NAVIGATION_PHRASE = re.compile(r"^(visit|go\s*to|back\s*to|view|see|read|explore|browse|return\s*to)\s", re.I)
NO_QUERY_TAGS = frozenset(("all", "more", "view all", "see all", "browse", "search", "library"))
CONTENTS_CLASS = re.compile(r"toc|table-of-contents", re.I)
CONTENT_CLASS = re.compile(r"content|post|article", re.I)
RESPONSES = re.compile(r"Responses?\s*\(\d+\)")
RESPONSE_CLASS = re.compile(r"response|comment|replies", re.I)
AUTHOR_CARD = re.compile(r"postMeta|authorCard|writer-card", re.I)
CALL = re.compile(r"(million|thousand)\s+people\s+have\s+(used|read)|Subscribe\s+here\.?\s*$", re.I)
REMARK = re.compile(r"BRAVO!|Well said|Thank [yY]ou|I (very much )?(appreciate|agree)")
MOST_MINUTES, MOST_TAGS, LONGEST_HEADING, RESPONSE_HEAD = 60, 15, 200, 500


def _strings(root) -> Iterator[tuple]:
    """(string, the node that it stands in), in document order."""
    stack = [(root, None)]
    while stack:
        x, home = stack.pop()
        if isinstance(x, str):
            yield x, home
        else:
            stack.extend((k, x) for k in reversed(x.kids))


def _above(node, *tags):
    node = node.parent
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def _within(node, *tags) -> list:
    return [n for n in node.walk() if n is not node and n.tag in tags]


def _first_string(root, pattern):
    return next(((m, home) for s, home in _strings(root) if (m := pattern.search(s))), (None, None))


def _profile_names(root) -> Iterator[tuple[str, str]]:
    """Of blog hosts: links to profiles, pictures beside such links, names beside a count of followers or "Written by"."""
    for a in _within(root, "a"):
        href, name = a.attrs.get("href", ""), a.plain()
        user = re.search(r"@(\w+)", href)
        if "/@" in href and not (user and user[1].lower() == name.lower()):
            yield "profile", name
    for img in _within(root, "img"):
        beside = _above(img, "div", "a")
        if not NO_ALT_NAME.match(alt := img.attrs.get("alt", "").strip()) and beside is not None and any("/@" in a.attrs.get("href", "") for a in _within(beside, "a")):
            yield "picture", alt
    _, home = _first_string(root, FOLLOWERS)
    if home is not None and (box := home if home.tag in ("div", "section") else _above(home, "div", "section")) is not None:
        yield from (("followers", n.plain()) for n in _within(box, "a", "h2", "h3", "h4", "span") if not re.search("follower|following", n.plain(), re.I))
    _, home = _first_string(root, re.compile("Written by", re.I))
    if home is not None and (card := _above(home, "div", "section", "li")) is not None:
        yield from (("card", a.plain()) for a in _within(card, "a") if "/tag/" not in a.attrs.get("href", "") and "subscribe" not in a.attrs.get("href", "").lower())


def author_candidates(root, blog: bool) -> Iterator[tuple[str, str]]:
    """(rule, name). The rules ``portrait`` and ``class`` hold as they are, others if they are like a name."""
    portrait = next((i for i in _within(root, "img") if PORTRAIT.search(i.attrs.get("alt", ""))), None)
    if portrait is not None and (box := _above(portrait, "li") or _above(portrait, "div") or _above(portrait, "a")):
        for n in _within(box, "span", "a", "p", "div"):
            name = n.plain()
            if 2 < len(name) < 50 and " " in name and not NO_PORTRAIT_NAME.match(name):
                yield "portrait", name
    if blog:
        yield from _profile_names(root)
    marked = next((n for n in root.walk() if AUTHOR_CLASS.search(n.attrs.get("class", ""))), None)
    linked = next((n for n in _within(root, "a") if AUTHOR_LINK.search(n.attrs.get("href", ""))), None)
    for n in (marked, linked):
        if n is not None and 2 < len(name := BY.sub("", n.plain())) < 60:
            yield "class", name


def minutes_candidates(root) -> Iterator[int]:
    """Numbers of "N min read", then of "N min" alone around the first heading, then of such a string anywhere."""
    read, _ = _first_string(root, MINUTES_READ)
    if read:
        yield int(read[1][:9])
    heading = next(iter(_within(root, "h1")), None)
    boxes = [b for tag in ("li", "div", "section", "header", "article") if heading is not None and (b := _above(heading, tag)) is not None]
    near = [n.plain() for b in boxes for n in _within(b, "span", "div", "p", "time")]
    alone = [s.strip() for s, home in _strings(root) if home is not None and home.tag in ("span", "div", "p") and len(home.kids) == 1]
    yield from (int(m[1][:9]) for x in [*near, *alone] if (m := MINUTES_ALONE.match(x)))


def tag_candidates(root) -> Iterator[tuple[str, str]]:
    """(rule, tag): links to topics, links in marked lists and behind a label, meta tags, keywords, links that query."""
    links = _within(root, "a")
    yield from (("topic", a.plain()) for a in links if TAG_LINK.search(a.attrs.get("href", "")))
    yield from (("list", a.plain()) for box in _within(root, "ul", "div", "nav", "section") if TAG_CLASS.search(box.attrs.get("class", "")) for a in _within(box, "a"))
    yield from (("label", a.plain()) for s, home in _strings(root) if TAG_LABEL.match(s.strip()) and home is not None for a in _within(home, "a"))
    metas = _within(root, "meta")
    yield from (("meta", m.attrs.get("content", "").strip()) for m in metas if m.attrs.get("property") == "article:tag")
    words = next((m.attrs.get("content", "") for m in metas if m.attrs.get("name") == "keywords"), "")
    yield from (("keywords", w.strip()) for w in words.split(","))
    for a in links:
        name = a.plain()
        if QUERY_LINK.search(a.attrs.get("href", "")) and 2 < len(name) < 40 and name.lower() not in NO_QUERY_TAGS and not name.startswith("http") and not NAVIGATION_PHRASE.match(name):
            yield "query", name


def contents(root) -> list[tuple[str, int]]:
    """(text, level): the links of a marked table of contents, on level 2, else the headings of the article."""
    for tag in ("nav", "div", "ul"):
        box = next((n for n in _within(root, tag) if CONTENTS_CLASS.search(n.attrs.get("class", ""))), None)
        found = [(name, 2) for a in _within(box, "a") if (name := a.plain())] if box is not None else []
        if found:
            return found
    area = next((n for tag in ("article", "main") for n in _within(root, tag)), None) or next((n for n in _within(root, "div") if CONTENT_CLASS.search(n.attrs.get("class", ""))), root)
    return [(name, int(h.tag[1])) for h in _within(area, "h1", "h2", "h3", "h4") if (name := h.plain()) and len(name) < LONGEST_HEADING]


def shown_title(root) -> str | None:
    """The first h1, or the part of it that an app balances in a span."""
    heading = next(iter(_within(root, "h1")), None)
    if heading is None:
        return None
    spans = _within(heading, "span")
    return (next((s for s in spans if "data-br" in s.attrs), spans[0]) if spans else heading).plain() or None


def drop_responses(root) -> None:
    """Take away what a blog host shows below an article: responses, remarks, calls with all that follows, author cards."""

    def response(n) -> bool:
        name, text = n.attrs.get("class", ""), n.plain()
        if n.tag in ("div", "section") and (RESPONSES.search(text[:RESPONSE_HEAD]) or RESPONSE_CLASS.search(name)):
            return not _within(n, "article")
        if n.tag in ("div", "section") and AUTHOR_CARD.search(name) and "followers" in text.lower() and "following" in text.lower():
            return True
        return bool(re.search("response|comment", n.attrs.get("data-testid", ""), re.I)) or (n.tag in ("p", "div") and bool(REMARK.match(text)))

    stack, called = [root], False
    while stack:
        n = stack.pop()
        kept = []
        for k in n.kids:
            if not isinstance(k, str):
                leaf = not _within(k, "div", "section", "p")
                if not called and leaf and k.tag in ("div", "section", "p") and CALL.search(k.plain()):
                    called = True  # the first call only: it goes, and what stands behind it
                    break
                if response(k):
                    continue
            kept.append(k)
        n.kids = kept
        stack.extend(k for k in reversed(kept) if not isinstance(k, str))


# -- columns ---------------------------------------------------------------------------------------------------


def author() -> Column:
    """The first candidate of ``author_candidates`` that holds."""
    holds = lambda c: c["rule"].isin("portrait", "class") | tx.name_like(c["text"])
    return F.get(F.filter("author_candidates", holds), F.lit(0))["text"]


def minutes() -> Column:
    return F.get(F.filter("minutes_candidates", lambda m: m.between(1, MOST_MINUTES)), F.lit(0))


def tags() -> Column:
    """The first distinct tags of ``tag_candidates``, in their order."""
    held = F.filter("tag_candidates", lambda c: (c["rule"] == "query") | tx.valid_tag(c["text"]))
    return F.slice(F.array_distinct(F.transform(held, lambda c: c["text"])), 1, MOST_TAGS)
