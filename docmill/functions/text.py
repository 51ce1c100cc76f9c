"""Text functions: column expressions only, all JVM-side.

Regular expressions follow one convention: ``(?md)`` where lines matter, so that only a newline ends a line, and
``(?U)`` where classes are meant for all of Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_PER_MINUTE = 225
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def strip_bound(x: Column) -> Column:
    """:func:`strip` of a lambda's variable or a column: what begins and ends with a printable ASCII character isn't searched."""
    return F.when(F.left(x, F.lit(1)).between("!", "~") & F.right(x, F.lit(1)).between("!", "~"), x).otherwise(strip(x))


def squeeze(x: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def missing_to_null(x: Column) -> Column:
    """Empty or blank counts as absent."""
    return F.nullif(strip(x), F.lit(""))


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern)).cast("long")


def occurrences(x: Column, part: str) -> Column:
    """How often a plain string occurs."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("long")


def is_upper(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x)


def token_estimate(x: Column) -> Column:
    """Four characters a token."""
    return F.floor(F.length(x) / 4).cast("long")


def word_total(x: Column) -> Column:
    """Words of two ASCII letters or more."""
    return count(x, r"(?U)\b[a-zA-Z]{2,}\b")


def reading_minutes(x: Column, given: Column | None = None) -> Column:
    own = F.greatest(F.lit(1), F.bround(word_total(x) / F.lit(float(WORDS_PER_MINUTE)), 0).cast("long"))
    return own if given is None else F.when(given > 0, given.cast("long")).otherwise(own)


def numerals(x: Column) -> Column:
    """Distinct numbers, normalised: commas, a percent sign and a last point are dropped; a hyphen behind a digit is no sign."""
    raw = F.regexp_extract_all(F.replace(x, F.lit("−"), F.lit("-")), F.lit(r"((?<!\d)-?\d[\d,]*\.?\d*%?)"), 1)
    plain = F.transform(raw, lambda n: F.regexp_replace(F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), "%+$", ""), r"\.+$", ""))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda n: (n != "") & (n != "-"))))


def years(x: Column) -> Column:
    """Distinct standalone four-digit numbers that begin with 1 or 2."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"((?<!\d)[12]\d{3}(?!\d))"), 1)))


def scrub_controls(x: Column) -> Column:
    return F.regexp_replace(x, CONTROLS, " ")


def printable_share(x: Column) -> Column:
    sample = F.left(x, F.lit(2000))
    return 1 - F.regexp_count(sample, F.lit(r"[\p{C}\p{Z}&&[^ \n\r\t]]")) / F.length(sample)


def content_valid(x: Column) -> Column:
    """100 characters or more, of whose first 2000 three quarters are printable, with ten words of three letters."""
    words = F.regexp_count(F.left(x, F.lit(2000)), F.lit(r"(?U)\b[a-zA-Z]{3,}\b"))
    return F.coalesce((F.length(x) >= 100) & (printable_share(x) >= 0.75) & (words >= 10), F.lit(False))


#: What isn't a person's name, and how a tag may not begin.
NO_NAMES = ("follow", "subscribe", "sign", "read", "write", "member", "response", "clap", "share", "more", "about", "help", "open")
NO_TAGS = ("home", "about", "contact", "blog", "all", "more", "see", "view", "read", "share", "library")


def name_like(x: Column) -> Column:
    size = F.length(x)
    refused = x.startswith("http") | x.startswith("@") | x.startswith("/") | x.rlike(r"(?U)^[\d\s.]+$") | F.lower(strip(x)).isin(*NO_NAMES)
    return F.coalesce(size.between(2, 60) & ~refused & x.rlike("[a-zA-Z]"), F.lit(False))


def valid_tag(x: Column) -> Column:
    words = F.size(F.filter(F.split(strip(x), r"(?U)\s+"), lambda w: w != ""))
    return F.coalesce(F.length(x).between(3, 49) & ~x.rlike("(?i)^(" + "|".join(NO_TAGS) + ")") & (words <= 4), F.lit(False))


#: What a paper's first page says.
PAPER_SIGNS = ("abstract", "introduction", "university", "department", "doi:", "journal of", "@", "received")


def academic_paper(x: Column) -> Column:
    signs = [F.contains(F.lower(x), F.lit(s)).cast("int") for s in PAPER_SIGNS]
    return F.coalesce(sum(signs[1:], signs[0]) >= 3, F.lit(False))


def _cut_at_word(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.regexp_replace(F.left(x, F.lit(most)), r" [^ ]*\z", "")).otherwise(x)


def file_stem(x: Column, most: int = 100, dash: bool = False) -> Column:
    """Safe for a file name. ``dash``: semicolons become dashes."""
    safe = F.regexp_replace(x, r'[<>:"/\\|?*]', "")
    safe = F.regexp_replace(safe, ";", " -") if dash else safe
    return _cut_at_word(strip(F.regexp_replace(safe, r"(?U)[\s_]+", " ")), most)


def _present(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def book_file_name(title: Column, author: Column, year: Column, edition: Column, stem: Column) -> Column:
    """Title - Author Year Ed.md, without brackets."""
    part = lambda x: _present(file_stem(x))
    short = F.replace(F.replace(part(edition), F.lit("Edition"), F.lit("Ed")), F.lit("edition"), F.lit("Ed"))
    parts = F.concat_ws(" ", part(F.coalesce(_present(title), stem)), F.concat(F.lit("- "), part(author)), _present(year), short)
    return F.concat(file_stem(F.regexp_replace(F.replace(parts, F.lit(".md"), F.lit("")), r"[()\[\]]", "")), F.lit(".md"))


def article_file_name(author: Column, title: Column, source: Column, url: Column) -> Column:
    """Author - Title - Source.md; the url's last path part and its host stand in for what is absent."""
    part = lambda x: _present(file_stem(x, 80, dash=True))
    slug = F.element_at(F.split(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), r"\A/+|/+\z", ""), "/"), -1)
    slug = F.initcap(F.regexp_replace(slug, "[-_]", " "))
    label = F.split_part(F.replace(F.try_parse_url(url, F.lit("HOST")), F.lit("www.")), F.lit("."), F.lit(1))
    label = F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substr(label, F.lit(2))))
    names = [F.coalesce(part(author), F.lit("Unknown Author")), F.coalesce(part(title), part(slug), F.lit("Untitled")), F.coalesce(part(source), label)]
    return F.concat(F.concat_ws(" - ", *names), F.lit(".md"))


def companion_path(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*\z", ""), F.lit(".rag.md"))


def redact(message: Column, secret: str) -> Column:
    return F.replace(message, F.lit(secret), F.lit("•••"))


def question_shape(x: Column) -> Column:
    """One question mark at the end."""
    q = strip(F.coalesce(x, F.lit("")))
    return F.when(q.endswith("?"), q).otherwise(F.concat(F.regexp_replace(q, r"[?.! ]+\z", ""), F.lit("?")))


def subject_first(x: Column, subject: Column) -> Column:
    """A text that opens with a pronoun gets its subject in front."""
    opens = x.rlike(r"(?U)\A(?:(?:He|She|It|They)\b|(?:This|These)\s)")
    return F.when(opens, F.concat(subject, F.lit(": "), x)).otherwise(x)


def preview(raw: Column, kind: Column) -> Column:
    """The first row of a table or figure, 40 characters of it."""
    first = strip(F.regexp_replace(strip(F.split_part(raw, F.lit("\n"), F.lit(1))), r"\A\|+|\|+\z", ""))
    return F.when(F.length(first) > 40, F.concat(F.left(first, F.lit(40)), F.lit("…"))).otherwise(F.coalesce(_present(first), kind))


def section_key(title: Column) -> Column:
    return F.lower(strip(F.regexp_replace(strip(title), r"\A[*_`:#]+|[*_`:#]+\z", "")))


#: Signs of a cut article.
CUT_SIGNS = ("subscribe to continue reading", "to continue reading", "sign in or create", "this article is for subscribers", "already a subscriber?", "subscribe now")


def cut_by_paywall(html: Column) -> Column:
    found = F.lit(False)
    for sign in CUT_SIGNS:
        found = found | F.contains(F.lower(html), F.lit(sign))
    return F.coalesce(found, F.lit(False))


def layout_date(x: Column) -> Column:
    """D:YYYYMMDD... as YYYY-MM-DD."""
    return F.regexp_replace(x, r"\AD:(\d{4})(\d{2})(\d{2}).*\z", "$1-$2-$3")


#: Date formats in the order they are tried; an offset is cut off before, as the date doesn't shift.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "d/M/yyyy")


def iso_date(x: Column) -> Column:
    """YYYY-MM-DD where a format fits or such a date is inside; else unchanged; null if empty."""
    plain = F.regexp_replace(strip(x), r"(?<=T\d{2}:\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})\z", "")
    tried = [F.date_format(F.try_to_timestamp(plain, F.lit(f)), "yyyy-MM-dd") for f in DATE_FORMATS]
    return F.when(x != "", F.coalesce(*tried, _present(F.regexp_extract(x, r"\d{4}-\d{2}-\d{2}", 0)), x))


def strip_fences(x: Column) -> Column:
    """JSON out of a code fence."""
    return F.regexp_replace(strip(x), r"\A```[a-zA-Z]*\s*|\s*```\z", "")


def retry_after(message: Column) -> Column:
    return F.regexp_extract(message, r"retryDelay\W+([0-9]+(?:\.[0-9]+)?)s?", 1).try_cast("double")


#: Seconds before each retry, and the most.
BACKOFF, MOST_BACKOFF = (2.0, 8.0, 30.0), 60.0


def backoff(attempt: Column, asked: Column) -> Column:
    """Seconds to wait after the attempt (from 1); null beyond the last."""
    planned = F.get(F.array(*[F.lit(b) for b in BACKOFF]), (attempt - 1).cast("int"))
    return F.when(planned.isNotNull(), F.least(F.greatest(planned, F.coalesce(asked, F.lit(0.0))), F.lit(MOST_BACKOFF)))


def final_error(code: Column, message: Column) -> Column:
    return F.coalesce(code.isin(400, 401, 403), F.lit(False)) | F.coalesce(message.rlike(r"(?i)api[ _]key|permission|unauthenticated|invalid argument"), F.lit(False))


def tidy(x: Column) -> Column:
    """Blank runs collapsed, lines without trailing white space, one newline at the end."""
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.concat(strip(F.regexp_replace(x, r"(?md)[ \t\r\f\x0B]+$", "")), F.lit("\n"))


def strip_html(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.regexp_replace(text, "<[^>]+>", " ")


def html_title(html: Column) -> Column:
    """The first of h1, h2 and title that says something, 120 characters of it."""
    part = lambda tag: _present(squeeze(strip_html(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))))
    return F.left(F.coalesce(part("h1"), part("h2"), part("title")), F.lit(120))


#: What parts a page title, in the order tried.
TITLE_BREAKS = (" | ", " - ", " – ", " — ", " :: ", " · ")


def longest_title_part(x: Column) -> Column:
    """The longest part at the first separator that occurs; the first of equals."""
    out = x
    for sep in reversed(TITLE_BREAKS):
        parts = F.transform(F.split(x, r"\Q" + sep + r"\E"), lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("at"), strip(p).alias("part")))
        out = F.when(F.contains(x, F.lit(sep)), F.array_max(parts)["part"]).otherwise(out)
    return out


def unescape(x: Column) -> Column:
    """The entities that text commonly holds; an ampersand last, so that nothing is unescaped twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def title_key(x: Column) -> Column:
    """A finding's title without quotes, digits, punctuation and case."""
    t = F.regexp_replace(F.lower(x), "[\"'“”‘’]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\d+", ""), r"[^a-z\s]", " "), r"\s+", " "))


def signature(category: Column, systemic: Column, title: Column) -> Column:
    basis = F.concat_ws("|", category, F.when(systemic, "True").otherwise("False"), title_key(title))
    return F.left(F.sha2(basis.cast("binary"), 256), F.lit(16))


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once: an expression that stands in a lambda is otherwise made again for each element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def keep_order_distinct(items: Column) -> Column:
    """Without blanks and repetitions of any case; the first spelling stays.

    Spellings are hashed and keys sorted with their places, so that a long list takes little more than its length.
    """
    clean = F.array_distinct(F.filter(F.transform(F.array_distinct(items), strip), lambda x: x != ""))

    def firsts(spelled: Column) -> Column:
        keyed = F.sort_array(F.transform(spelled, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at"))))
        places = lambda k: F.filter(k, lambda z, j: (j == 0) | (z["key"] != F.get(k, j - 1)["key"]))
        return F.transform(F.sort_array(F.transform(bound(keyed, places), lambda z: z["at"])), lambda at: F.get(spelled, at))

    return bound(clean, firsts)
