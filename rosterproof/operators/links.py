"""Document links in HTML pages, and unions of document address lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.functions import dom, fixed, urls
from rosterproof.functions.extract import guess_doc_type
from rosterproof.functions.keys import first_given, given
from rosterproof.functions.text import blank_to_null, trim_blanks

_EXT = "|".join(fixed.FILE_EXTENSIONS)
# The four ways a script names a file, tried in this order.
_ONCLICK = [
    rf"(?i)['\"]([^'\"]+\.(?:{_EXT}))['\"]",
    r"(?i)window\.open\(['\"]([^'\"]+)['\"]",
    r"(?i)downloadFile\(['\"]([^'\"]+)['\"]",
    r"(?i)['\"]([^'\"]+/[^'\"]+)['\"]",
]


def _structs(array: Column, **fields: Callable[[Column], Column]) -> Column:
    """The array's structs with fields added or replaced."""

    def more(x: Column) -> Column:
        for name, f in fields.items():
            x = x.withField(name, f(x))
        return x

    return F.transform(array, more)


def _elements(pages: DataFrame, id_col: str) -> DataFrame:
    """Pages with ``found``, their links and buttons in page order, and ``viewers``.

    Each link or button has pos, text, its attributes and the address it leads to.
    """

    def target(e: Column) -> Column:
        href = e["attr_href"]
        scripted = ~given(href) | href.startswith("javascript:") | (href == "#")
        script = F.coalesce(*[blank_to_null(F.regexp_extract(e["onclick"], p, 1)) for p in _ONCLICK])
        return F.when(scripted, script).otherwise(urls.resolve(href, F.col("__page")))

    read = pages.select(id_col, F.col("url").alias("__page"), dom.elements(F.col("html")).alias("__e"))
    found = _structs(F.col("__e.clicks"), text=lambda e: trim_blanks(e["text"]))
    return read.select(
        id_col, "__page", _structs(found, href=target).alias("found"), F.col("__e.viewers").alias("viewers")
    )


def page_links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Document links of each page: (id, part, pos, url, text, type), first per address.

    ``pages`` has an id, ``url`` and ``html``. A lightbox link keeps its file in
    data-src; else href or the script behind it counts; inline viewers come last. A page
    is one row until its links are known, so nothing is shuffled.
    """

    def clicked(e: Column) -> Column:
        boxed = F.coalesce(urls.is_file(e["data_src"]), F.lit(False))
        wanted = urls.is_document_link(e["text"], e["href"])
        href = F.when(boxed, e["data_src"]).when(wanted, e["href"])
        return F.struct(
            F.lit(0).alias("part"), e["pos"].alias("pos"), href.alias("url"), e["text"].alias("text")
        )

    def viewed(v: Column) -> Column:
        return F.struct(
            F.lit(1).alias("part"),
            v["pos"].alias("pos"),
            F.when(urls.is_file(v["src"]), v["src"]).alias("url"),
            F.lit("").alias("text"),
        )

    # Addresses from attributes are resolved against the site, not the page.
    site = F.concat(urls.origin_of(F.col("__page")), F.lit("/"))
    usable = F.filter("all", lambda x: given(x["url"]))
    kept = F.filter(
        _structs(usable, url=lambda x: urls.resolve(x["url"], site)),
        lambda x: given(x["url"]) & ~x["url"].startswith("javascript:") & ~x["url"].endswith("#"),
    )
    name = F.regexp_extract(F.col("l.url"), r"[^/]*\z", 0)
    return (
        _elements(pages, id_col)
        .withColumn("all", F.concat(F.transform("found", clicked), F.transform("viewers", viewed)))
        .withColumn("all", kept)
        .withColumn("all", by_url(F.col("all")))
        .select(id_col, F.explode(first_of_runs(F.col("all"))).alias("l"))
        .select(
            id_col,
            "l.part",
            "l.pos",
            "l.url",
            F.coalesce(first_given(F.col("l.text")), name).alias("text"),
            guess_doc_type(F.concat_ws(" ", "l.text", "l.url")).alias("type"),
        )
    )


def by_url(links: Column) -> Column:
    """Links (an array of structs) in the order of their ``url``, its first link in front."""
    return F.array_sort(F.transform(links, lambda x, i: F.struct(x["url"], i.alias("at"), x.alias("link"))))


def first_of_runs(ordered: Column) -> Column:
    """The first link of each address of an array from ``by_url``, in the order given there.

    A column of its own goes in: sorted once, each link is compared to the one before it,
    so a page of any number of links takes n log n steps.
    """
    first = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["url"] != x["url"]))
    back = F.array_sort(F.transform(first, lambda x: F.struct(x["at"], x["link"])))
    return F.transform(back, lambda x: x["link"])


def modal_links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Links of a modal dialog that lead to documents, then links to the review page."""

    def entry(e: Column, part: int, when: Column, url: Column, text: Column, kind: str | None) -> Column:
        fields = {
            "part": F.lit(part),
            "pos": e["pos"],
            "url": url,
            "text": text,
            "type": F.lit(kind).cast("string"),
        }
        return F.when(when, F.struct(*[v.alias(k) for k, v in fields.items()]))

    def entries(e: Column) -> Column:
        url, own = e["url"], e["own"]
        leads = given(url) & urls.is_modal_link(url)
        review = e["text"].contains(fixed.REVIEW_LINK_TEXT) & given(own)
        return F.array(
            entry(e, 0, e["is_link"] & leads, url, e["text"], None),
            entry(e, 1, e["is_link"] & review, own, F.lit(fixed.REVIEW_LINK_TEXT), "review_page"),
        )

    # A scripted link without a readable target keeps its own href.
    with_urls = _structs(
        F.col("found"),
        url=lambda e: F.coalesce(e["href"], e["attr_href"]),
        own=lambda e: F.when(e["attr_href"] != "#", urls.resolve(e["attr_href"], F.col("__page"))),
    )
    return (
        _elements(pages, id_col)
        .withColumn("found", with_urls)
        .select(
            id_col,
            F.inline(F.filter(F.flatten(F.transform("found", entries)), lambda x: x.isNotNull())),
        )
    )


def _exploded(df: DataFrame, array: str, rank: int, **fields: Column) -> DataFrame:
    return df.select("request_id", F.posexplode(array).alias("pos", "d")).select(
        "request_id", F.lit(rank).alias("rank"), "pos", *[v.alias(k) for k, v in fields.items()]
    )


def document_urls(submissions: DataFrame) -> DataFrame:
    """Every document address of each request, the first source of an address winning.

    Sources in order: documents, document_urls, api_document_urls ({key, value}), the
    authority's ID card, the admin's ID card. ``documents`` keeps repeats of its own. All
    sources are arrays of the request's row and are merged there.
    """

    def entry(rank: int, pos: Column, url: Column, text: Column, kind: Column) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"),
            pos.cast("int").alias("pos"),
            url.alias("url"),
            text.alias("text"),
            kind.alias("type"),
        )

    def link(rank: int):
        return lambda d, i: entry(rank, i, d["url"], d["text"], d["type"])

    def api(d: Column, i: Column) -> Column:
        return entry(2, i, d["value"], d["key"], F.lit(None).cast("string"))

    def card(rank: int, person: str, text: str) -> Column:
        url = F.col(f"{person}.id_doc_url")
        return F.array(entry(rank, F.lit(0), url, F.lit(text), F.lit("id_card")))

    def usable(array: Column) -> Column:
        return F.filter(F.coalesce(array, F.array().cast(_ROWS)), lambda x: given(x["url"]))

    listed = usable(F.transform("documents", link(0)))
    rest = F.concat(
        usable(F.transform("document_urls", link(1))),
        usable(F.transform("api_document_urls", api)),
        usable(card(3, "authority_info", fixed.CARD_TEXT_AUTHORITY)),
        usable(card(4, "admin_info", fixed.CARD_TEXT_ADMIN)),
    )
    # Listed links keep their repeats; one of the rest goes where its address came before.
    every = F.concat(
        F.transform("listed", lambda x: x.withField("of_rest", F.lit(False))),
        F.transform("rest", lambda x: x.withField("of_rest", F.lit(True))),
    )
    back = F.array_sort(F.transform(_new_or_listed(F.col("every")), lambda x: F.struct(x["at"], x["link"])))
    return (
        submissions.select("request_id", listed.alias("listed"), rest.alias("rest"))
        .select("request_id", by_url(every).alias("every"))
        .select("request_id", F.inline(F.transform(back, lambda x: x["link"].dropFields("of_rest"))))
    )


def _new_or_listed(ordered: Column) -> Column:
    before = lambda i: F.get(ordered, i - 1)["url"]
    return F.filter(
        ordered, lambda x, i: ~x["link"]["of_rest"] | (i == 0) | (before(i) != x["url"])
    )


def _first_per_url(known: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of ``more`` whose address is not in ``known``, one (the first) per address."""
    keys = ["request_id", "url"]
    seen = known.select(*keys, F.lit(True).alias("seen"), F.lit(None).cast(_ROW).alias("row"))
    new = more.select(
        *keys, F.lit(False).alias("seen"), F.struct("rank", "pos", "text", "type").alias("row")
    )
    return (
        seen.unionByName(new)
        .groupBy(*keys)
        .agg(F.max("seen").alias("seen"), F.min("row").alias("row"))
        .where(~F.col("seen"))
        .select("request_id", "row.rank", "row.pos", "url", "row.text", "row.type")
    )


_ROW = "struct<rank:int,pos:int,text:string,type:string>"
_ROWS = "array<struct<rank:int,pos:int,url:string,text:string,type:string>>"


def merge_documents(submissions: DataFrame, scraped: DataFrame) -> DataFrame:
    """Submitted documents plus scraped ones (request_id, pos, url, text, type) new by url."""
    d = F.col("d")
    listed = _exploded(submissions, "documents", 0, url=d["url"], text=d["text"], type=d["type"])
    found = scraped.select("request_id", F.lit(1).alias("rank"), "pos", "url", "text", "type")
    return listed.unionByName(_first_per_url(listed, found))
