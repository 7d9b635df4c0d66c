"""URL columns: canonical form, resolution, allow-list, file predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterproof.functions import fixed

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def canonical(url: Column, host: str) -> Column:
    """https address of a document: http upgraded, a path put behind ``host``."""
    return (
        F.when(url.startswith("http://"), F.regexp_replace(url, "^http://", "https://"))
        .when(url.startswith("/"), F.concat(F.lit(host), url))
        .when(~url.startswith("http"), F.concat(F.lit(f"{host}/"), url))
        .otherwise(url)
    )


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0)


def directory_of(url: Column) -> Column:
    """The page address up to its last slash, without query and fragment."""
    path = F.regexp_replace(url, r"[?#].*\z", "")
    has_path = path.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]+/")
    return F.when(has_path, F.regexp_replace(path, r"[^/]*\z", "")).otherwise(
        F.concat(path, F.lit("/"))
    )


def percent_encode(url: Column) -> Column:
    """Encode blanks and non-ASCII characters, as a browser shows an address."""
    chars = F.split(url, "")
    encoded = F.transform(
        chars,
        lambda ch: F.when(ch == " ", "%20")
        .when(ch.rlike(r"[^\x00-\x7F]"), F.url_encode(ch))
        .otherwise(ch),
    )
    return F.when(url.rlike(r"[^\x00-\x7F]| "), F.array_join(encoded, "")).otherwise(url)


def _without_dots(url: Column) -> Column:
    """An http address with ``.`` and ``..`` taken out of its path."""
    head = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(url, r"(?s)[?#].*\z", 0)
    names = F.split(F.substr(path, F.lit(2)), "/")

    def step(done: Column, name: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(name == "..", up).when(name == ".", done).otherwise(F.array_append(done, name))

    folded = F.aggregate(names, F.array().cast("array<string>"), step)
    # A path that ends in a dot segment names a directory.
    end = F.when(path.rlike(r"/\.{1,2}\z") & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit(""))
    clean = F.concat(head, F.lit("/"), F.array_join(folded, "/"), end, tail)
    return F.when(path.rlike(r"/\.{1,2}(?:/|\z)"), clean).otherwise(url)


def resolve(href: Column, page: Column) -> Column:
    """Absolute address of a link on the page ``page``, as a browser resolves it.

    Null when it cannot be one. A bare query keeps the page's path, a bare fragment the
    whole page address, and dot segments are removed.
    """
    bare = F.regexp_replace(page, r"(?s)#.*\z", "")
    full = (
        F.when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page, _SCHEME, 0), href))
        .when(href.startswith("/"), F.concat(origin_of(page), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(bare, r"(?s)\?.*\z", ""), href))
        .when(href.startswith("#") | (href == ""), F.concat(bare, href))
        .otherwise(F.concat(directory_of(page), href))
    )
    web = full.rlike(r"^(?i:https?):")
    broken = web & ~full.rlike(r"^(?i:https?)://[^/?#\s]+")
    return F.when(~broken, percent_encode(F.when(web, _without_dots(full)).otherwise(full)))


def is_api_url(url: Column) -> Column:
    """True for the request addresses whose responses are worth keeping."""
    return url.rlike(f"(?i){'|'.join(fixed.API_URL_PATTERNS)}")


def is_json(content_type: Column) -> Column:
    return F.coalesce(content_type, F.lit("")).contains("application/json")


def is_file(url: Column) -> Column:
    return url.rlike(rf"(?i)\.({'|'.join(fixed.FILE_EXTENSIONS)})(\?|\z)")


def _has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def is_document_link(text: Column, href: Column) -> Column:
    """A link to a document: a file by extension, or a telling text or path.

    A link without text counts only when it is a file.
    """
    by_word = _has_any(text, fixed.LINK_TEXT_WORDS) | _has_any(href, fixed.LINK_HREF_WORDS)
    return is_file(href) | ((text != "") & by_word)


def is_modal_link(href: Column) -> Column:
    return _has_any(href, fixed.MODAL_HREF_WORDS)
