"""Column functions of articles: URLs, text, dates, tags, replies of a language model."""

from __future__ import annotations

import unicodedata
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.words import ENGLISH, JAPANESE, TRACKING

#: White space as Python's str.split and re see it.
_WS = r"[\s\x1c-\x1f]"


def _str(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


# URLs

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: URLs that are as they should be: a scheme and a host in small letters, names between single slashes, and nothing else.
_CANONICAL = r"^https?://[a-z0-9.-]+(?:/[A-Za-z0-9_.~-]+)+\z"


def _decoded(c: Column) -> Column:
    spaced = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(spaced), spaced)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column | str) -> Column:
    """The canonical form by which articles are told apart; '' for null and ''."""
    u = F.regexp_replace(_str(url), rf"(?U)^{_WS}+|{_WS}+\z", "")
    part = lambda i: F.regexp_extract(u, _URL, i)
    scheme = F.when(part(1) == "", F.lit("https")).otherwise(F.lower(part(1)))
    host = F.lower(part(2))
    host = F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", "")).when((scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_replace(part(3), ";[^/]*$", ""), "/+", "/")
    path = F.when(path == "", F.lit("/")).when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    pairs = F.filter(F.split(part(4), "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    pairs = F.transform(pairs, lambda p, i: F.struct(_decoded(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"), i.alias("i"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    pairs = F.sort_array(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING) & ~p["k"].startswith("utm_")))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    base = F.when((host != "") | path.startswith("/"), F.concat(scheme, F.lit("://"), host, path)).otherwise(F.concat(scheme, F.lit(":"), path))
    made = F.concat(base, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(_str(url) == "", F.lit("")).when(_str(url).rlike(_CANONICAL), _str(url)).otherwise(made)


def join_url(base: Column, link: Column) -> Column:
    """An absolute URL for a link of a page: absolute, scheme-relative, root-relative or relative."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(site, F.regexp_extract(F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), r"^(.*/)", 1))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(site, F.lit("/")))
    relative = F.concat(folder, link)
    for _ in range(4):  # a/../ and ./ of the usual depth
        relative = F.regexp_replace(F.regexp_replace(relative, r"/\./", "/"), r"(?<!/)/(?!\.\./)[^/]+/\.\./", "/")
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(site, link)).when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), link)).otherwise(relative)


# Text


def clean_text(text: Column | str) -> Column:
    """Unix line ends, single blanks, stripped lines, at most one empty line in a row; '' for null."""
    t = F.regexp_replace(_str(text), r"\r\n|\r", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?Umd)^[\s\x1c-\x1f&&[^\n]]+|[\s\x1c-\x1f&&[^\n]]+$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, rf"(?U)^{_WS}+|{_WS}+\z", "")


def content_hash(title: Column | str, content: Column | str) -> Column:
    """SHA-256 of the cleaned title, a line end and the cleaned content, in hex."""
    return F.sha2(F.concat(clean_text(title), F.lit("\n"), clean_text(content)), 256)


@F.udf(T.StringType(), useArrow=False)  # Python gets 100 rows at a time: a title may be as long as a text
def _nfkc(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFKC", x)


def normalize_title(title: Column | str) -> Column:
    """NFKC without white space. Only titles beyond ASCII visit Python."""
    t = _str(title)
    return F.regexp_replace(F.when(t.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(t.rlike(r"[^\x00-\x7F]"), t))).otherwise(t), rf"(?U){_WS}+", "")


def one_line(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_str(text), rf"(?U){_WS}+", " "), "^ | $", "")


def shortened(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def preview(text: Column, n: int = 300) -> Column:
    return F.left(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(n))


def category_title(c: Column) -> Column:
    """Upper case up to four letters, else only the first letter upper."""
    return F.when(F.length(c) <= 4, F.upper(c)).otherwise(F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2**31 - 1))))


# Dates. All are wall-clock times of the publisher: an offset in the text is dropped.


@F.pandas_udf(T.TimestampNTZType())
def _fuzzy(s: pd.Series) -> pd.Series:
    from dateutil import parser

    def one(x: str | None) -> datetime | None:
        try:
            first, second = (parser.parse(x, fuzzy=True, default=datetime(y, m, d)) for y, m, d in ((2001, 2, 3), (2004, 5, 6)))
        except (ValueError, OverflowError, TypeError):
            return None
        return first.replace(tzinfo=None) if first == second else None  # a date with parts missing isn't one

    return pd.to_datetime(s.map(one))


def parse_datetime(text: Column | str) -> Column:
    """TIMESTAMP_NTZ of the usual forms of dates; null where no whole date is found."""
    t = F.trim(_str(text))
    t = F.regexp_replace(t, r"(\d{4})年(\d{1,2})月(\d{1,2})日", "$1-$2-$3")
    iso = F.regexp_replace(t, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", "$1-$2-$3")
    iso = F.regexp_replace(F.regexp_replace(iso, r"^(\d{4})-(\d)(?=\D)", "$1-0$2"), r"^(\d{4}-\d{2})-(\d)(?=\D|$)", "$1-0$2")
    iso = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?$"), F.regexp_extract(iso, r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?)", 1))
    mail = F.regexp_replace(t, r"^[A-Za-z]{3},\s*", "")
    mail = F.regexp_extract(mail, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    known = F.coalesce(iso.try_cast("timestamp_ntz"), F.try_to_timestamp(F.when(mail != "", mail), F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz"))
    rest = F.when(known.isNull() & t.rlike(r"\d"), t)
    return F.coalesce(known, F.when(rest.isNotNull(), _fuzzy(rest)))


def sort_time() -> Column:
    return F.coalesce("published_at", "fetched_at")


def article_date() -> Column:
    """The day of an article: that of its fetch where it has no date, or one over a day after the fetch."""
    return F.to_date(F.when(F.col("published_at").isNull() | (F.col("published_at") > F.col("fetched_at") + F.expr("INTERVAL 1 DAY")), F.col("fetched_at")).otherwise(F.col("published_at")))


def clock() -> Column:
    """HH:mm, or --:-- for an article without a date of its own."""
    return F.when(F.to_date("published_at") == article_date(), F.date_format("published_at", "HH:mm")).otherwise(F.lit("--:--"))


# Words and tags


#: What Python's \b parts, spelt out: Java's sees no numbers but digits, and sees marks.
_LETTER = r"[\p{L}\p{N}_]"
_WORD = rf"(?:(?<!{_LETTER})(?=[a-zA-Z0-9])|(?<={_LETTER})(?=-))[a-zA-Z0-9-]{{2,}}(?:(?<=[a-zA-Z0-9])(?!{_LETTER})|(?<=-)(?={_LETTER}))"


def english_words(text: Column) -> Column:
    """Lower-case words of at least two letters, digits or hyphens, without stop words and numbers."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*sorted(ENGLISH)) & ~w.rlike(r"^[0-9.-]+$"))


def script_runs(text: Column) -> Column:
    """Default segmenter of Japanese: runs of kanji, katakana or Latin letters and digits; hiragana parts them."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{IsHan}々]+|[\p{IsKatakana}ー]+|[A-Za-z0-9][A-Za-z0-9.-]*"), F.lit(0))
    return F.filter(runs, lambda w: (F.length(w) > 1) & ~w.isin(*sorted(JAPANESE)) & ~w.rlike(r"^[0-9.]+$"))


def clean_tags(tags: Column) -> Column:
    """Lower-case tags of over one letter that are no number and no stop word."""
    lowered = F.transform(tags, lambda t: F.trim(F.lower(t)))
    return F.filter(lowered, lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d+$") & ~t.isin(*sorted(ENGLISH | JAPANESE)))


def merge_tags(tags: Column, more: Column) -> Column:
    """``tags``, then those of ``more`` that are not blank nor in it in any case; null if none is left."""
    start = F.coalesce(tags, F.array().cast("array<string>"))
    add = lambda acc, k: F.when(F.exists(acc, lambda t: F.lower(t) == F.lower(F.trim(k))) | (F.trim(k) == ""), acc).otherwise(F.array_append(acc, F.trim(k)))
    merged = F.aggregate(F.filter(F.coalesce(more, F.array().cast("array<string>")), lambda k: k.isNotNull()), start, add)
    return F.when(F.size(merged) > 0, merged)


def tags_of_json(json: Column) -> Column:
    """Tags of JSON text; malformed text has none."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


# Language models


def model_input(title: Column, summary: Column, content: Column, most: int = 8000) -> Column:
    """The parts of an article that are not empty, named, parted by a blank line, cut at ``most`` characters."""
    named = lambda name, c: F.when(_str(c) != "", F.concat(F.lit(f"{name}: "), c))
    return F.left(F.concat_ws("\n\n", named("Title", title), named("Summary", summary), named("Content", content)), F.lit(most))


def parse_reply(reply: Column) -> Column:
    """STRUCT title_ja, summary_ja, keywords of JSON text, bare or in a fence; null without the first two."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    json = F.when(fenced != "", fenced).otherwise(F.trim(reply))
    made = F.from_json(json, "title_ja string, summary_ja string, keywords array<string>")
    return F.when(made["title_ja"].isNotNull() & made["summary_ja"].isNotNull(), F.struct(made["title_ja"].alias("title_ja"), made["summary_ja"].alias("summary_ja"), F.coalesce(made["keywords"], F.array().cast("array<string>")).alias("keywords")))


def failure(message: Column) -> Column:
    return F.left(F.coalesce(F.nullif(message, F.lit("")), F.lit("Unknown error")), F.lit(500))


# Search


def _folds() -> tuple[str, str]:
    """Latin letters with marks, and the letters that are left without them."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folds()


def folded(text: Column) -> Column:
    """Lower case without marks on Latin letters."""
    return F.lower(F.translate(text, _FROM, _TO))


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits, folded."""
    return F.filter(F.split(folded(_str(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def padded(words: Column) -> Column:
    """Tokens as one text in which each stands between blanks of its own, so that phrases can be counted."""
    return F.when(F.size(words) == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))
