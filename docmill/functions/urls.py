"""URL predicates and pagination, on the url alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts behind a paywall, query parts of gift links, and pagination parameters in order.
PAYWALLED = ("wsj.com", "nytimes.com", "ft.com", "economist.com", "washingtonpost.com", "bloomberg.com", "theathletic.com")
GIFTS = ("st=", "unlocked_article_code=", "gift=", "share=", "token=")
PAGE_PARAMS = ("page", "paged", "pagina", "pg", "p")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def query(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))


def on_domain(url: Column, *domains: str) -> Column:
    """On one of the domains or below it."""
    found = F.lit(False)
    for d in domains:
        found = found | (host(url) == d) | host(url).endswith("." + d)
    return F.coalesce(found, F.lit(False))


def is_thread(url: Column) -> Column:
    return on_domain(url, "reddit.com", "redd.it")


def is_blog_post(url: Column) -> Column:
    return on_domain(url, "medium.com")


def is_paywalled(url: Column) -> Column:
    return on_domain(url, *PAYWALLED)


def is_gift(url: Column) -> Column:
    found = F.lit(False)
    for g in GIFTS:
        found = found | F.contains(F.lower(query(url)), F.lit(g))
    return found


def _value(url: Column, param: str) -> Column:
    """The last value of a parameter, if it is a number."""
    values = F.regexp_extract_all(query(url), F.lit(rf"(?:^|&){param}=([^&]*)"), 1)
    last = F.element_at(values, -1)
    return F.when((F.size(values) > 0) & last.rlike(r"\A[0-9]+\z"), last)


def page_param(url: Column) -> Column:
    return F.coalesce(*[F.when(_value(url, p).isNotNull(), F.lit(p)) for p in PAGE_PARAMS])


def page_number(url: Column) -> Column:
    return F.coalesce(*[_value(url, p) for p in PAGE_PARAMS]).cast("long")


def page_url(url: Column, param: Column, number: Column) -> Column:
    """The url with the parameter set, wherever it stands, or appended; other parameters and the rest as they are."""
    base, rest = F.regexp_extract(url, r"\A([^?#]*)", 1), F.regexp_extract(url, r"(#.*)\z", 1)
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    mine = lambda p: F.split_part(p, F.lit("="), F.lit(1)) == param
    setting = F.concat(param, F.lit("="), number.cast("string"))
    changed = F.transform(pairs, lambda p: F.when(mine(p), setting).otherwise(p))
    whole = F.when(F.exists(pairs, mine), changed).otherwise(F.concat(pairs, F.array(setting)))
    return F.concat(base, F.lit("?"), F.array_join(whole, "&"), rest)
