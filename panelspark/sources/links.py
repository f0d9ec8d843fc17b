"""Which files a set of index pages links to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import keep_latest

# Wanted file endings, unwanted parts of an address, and roll-up archives
# that repeat what the small files hold.
FILE_SUFFIXES = (".zip", ".csv")
SKIPPED_PARTS = (
    "/NEMDE/",
    "/Gas_Supply_Guarantee/",
    "/VicGas/",
    "_GAS_",
    "/DWGM/",
    "Predispatch",
    "FCAS",
    "BIDPEROFFER",
    "BIDDAYOFFER",
    "BIDOFFER",
    "BID_OFFER",
    "BIDMOVE",
    "BIDTYPES",
    "BIDDUIDDETAILS",
    "RESIDUE_PRICE_FUNDS_BID",
    "DISPATCHCONSTRAINT",
    "DAYOFFER",
    "MTPASA_OFFER",
    "MTPASA",
    "PDPASA",
    "STPASA",
    "PRUDENTIAL",
    "MMSDM_CLI_",
    "MMSDM_GUI_",
    "CONSTRAINTSOLUTION",
)
ROLL_UP = r"MMSDM_\d{4}_\d{2}.zip"

# The page as tokens, each the text in front of a tag and the tag. Every position begins a token and nothing
# is tried twice, which keeps the search linear. Comments, scripts and styles are one token, as is what an
# unclosed one or an unclosed tag leaves. A quote opens a value only behind an equals sign.
INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TOKEN = (
    r"(?is)[^<]*+(?:<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<(?=[a-z/])"
    + INSIDE
    + r"(?:>|\z)|<|\z)"
)
ANCHOR = r"(?is)^[^<]*+<a[\s/].*>$"
BASE = r"(?is)^[^<]*+<base[\s/].*>$"
ATTRIBUTE = r"""(?s)[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+)?+"""
HREF = r"(?is)^href\s*="
# Entities an address is coded with.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
# a listing shows the size between the half of the day and the anchor
LISTED_SIZE = r"(?i)\b[AP]M\s+(\d+)\s*<a\s"


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def _path(url: Column) -> Column:
    return F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))


def without_dots(link: Column) -> Column:
    """Resolve ``.`` and ``..`` steps of an address."""
    root = F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(link, r"([?#].*)$", 1)
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
    steps = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", up(done)).when(step == ".", done).otherwise(F.array_append(done, step)),
    )
    # a path that ends in a dot step names the folder
    slash = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(root, F.array_join(steps, "/"), slash, rest)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), plain).otherwise(link)


def absolute(page: Column, href: Column) -> Column:
    """An address relative to its page made absolute, with dot steps resolved."""
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return without_dots(
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat_ws("/", folder, href))
    )


def decoded(text: Column) -> Column:
    """Entities, named or by number, replaced once; a number that is no character gives U+FFFD."""

    def after(piece: Column) -> Column:
        number = F.when(
            piece.rlike(r"^#[0-9]{1,7};"), F.regexp_extract(piece, r"^#([0-9]{1,7});", 1).try_cast("bigint")
        ).when(piece.rlike(r"^#[xX][0-9a-fA-F]{1,6};"), F.conv(F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+);", 1), 16, 10).try_cast("bigint"))
        point = F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF) | (number == 0), F.lit(0xFFFD)).otherwise(number)
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        rest = F.regexp_replace(piece, r"^#?[0-9A-Za-z]+;", "")
        out = F.when(point.isNotNull(), F.concat(char, rest))
        for name, sign in ENTITIES.items():
            out = out.when(piece.startswith(f"{name};"), F.concat(F.lit(sign), rest))
        return out.otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    first, others = F.get(pieces, F.lit(0)), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.when(F.contains(text, F.lit("&")), F.concat(first, F.array_join(F.transform(others, after), ""))).otherwise(text)


def _raw_href(token: Column) -> Column:
    """The first href attribute of a tag as written, NULL if it has none."""
    tag = F.regexp_replace(token, r"^[^<]*+<[A-Za-z]+", "")
    return F.get(F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 0), lambda a: a.rlike(HREF)), F.lit(0))


def _with_value(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add the decoded value of an attribute; step by step, as each step is used more than once by the next."""
    value, bare = F.col("_value"), F.col("_bare")
    quoted = value.rlike(r"""^["']""") & (F.length(value) > 1)
    return (
        df.withColumn("_value", F.regexp_replace(raw, r"(?s)^[^=]*+=\s*+", ""))
        .withColumn("_bare", F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value))
        .withColumn(out, F.trim(decoded(bare)))
        .drop("_value", "_bare")
    )


def extract_links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every link of every page: (page_id, url, pos, href, link, size), size being the number listed in front.

    Values may stand in quotes or without, entities are decoded, links in comments and scripts are none, and
    addresses are relative to the page's first ``<base href>`` where it has one. A null page has no links.
    """
    tokens = F.regexp_extract_all(html, F.lit(TOKEN), 0)
    wanted = F.filter(tokens, lambda t: t.rlike(ANCHOR) | t.rlike(BASE))
    read = F.transform(wanted, lambda t: F.struct(t.rlike(BASE).alias("base"), t.alias("token"), _raw_href(t).alias("raw")))
    found = pages.select(F.col(page_id), F.col(url), F.filter(read, lambda t: t["raw"].isNotNull()).alias("_t"))
    based = _with_value(found.withColumn("_raw", F.get(F.filter("_t", lambda t: t["base"]), F.lit(0))["raw"]), "_raw", "_base")
    home = F.when(F.col("_base").isNotNull(), absolute(F.col(url), F.col("_base"))).otherwise(F.col(url))
    anchors = F.filter("_t", lambda t: ~t["base"])
    rows = based.select(page_id, url, home.alias("_home"), F.posexplode(anchors).alias("pos", "_a"))
    rows = rows.select(page_id, url, "_home", "pos", F.col("_a.token").alias("_token"), F.col("_a.raw").alias("_raw"))
    # a generator of one row: filters on links stay above it instead of repeating the whole decoding
    read_once = _with_value(rows, "_raw", "_href").withColumn("href", F.explode(F.array("_href")))
    return read_once.select(
        page_id,
        url,
        "pos",
        "href",
        absolute(F.col("_home"), F.col("href")).alias("link"),
        F.regexp_extract("_token", LISTED_SIZE, 1).try_cast("bigint").alias("size"),
    )


def link_inventory(
    links: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    suffixes: Sequence[str] = FILE_SUFFIXES,
    skip: Sequence[str] = SKIPPED_PARTS,
    roll_up: str | None = ROLL_UP,
    children_only: bool = True,
) -> DataFrame:
    """(file_name, link, size): the wanted files, each name once.

    Links must lead to the page's own host (with or without www) and, with ``children_only``,
    below its path. Of several links to one file name the last page's last link is kept; a
    name linked from every page is reduced to one row per map task before the shuffle.
    """
    link = F.col("link")
    wanted = (_host(link) == _host(F.col(url))) & ~link.endswith("/")
    if children_only:
        wanted = wanted & _path(link).startswith(F.concat(_path(F.col(url)), F.lit("/")))
    if suffixes:
        ending = F.lit(False)
        for suffix in suffixes:
            ending = ending | F.lower(link).endswith(suffix)
        wanted = wanted & ending
    for part in skip:
        wanted = wanted & ~F.contains(F.lower(link), F.lit(part.lower()))
    if roll_up:
        wanted = wanted & ~link.rlike(roll_up)
    named = links.where(wanted).withColumn("file_name", F.element_at(F.split("link", "/"), -1))
    kept = keep_latest(
        named.select("file_name", page_id, "pos", "link", "size"), ["file_name"], [f"-{page_id}", "-pos"]
    )
    return kept.select("file_name", "link", "size")


def by_size(inventory: DataFrame) -> DataFrame:
    """Largest first, unknown sizes last."""
    return inventory.orderBy(F.desc_nulls_last("size"), "file_name")
