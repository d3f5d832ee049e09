"""Text expressions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stem(t: Column) -> Column:
    """``-ies`` to ``-y``, else one trailing ``s`` (not ``ss``) off longer words."""
    ies = (F.length(t) > 4) & t.endswith("ies")
    s = (F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss")
    return F.when(ies, F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y"))).when(s, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def tokens(text: Column | str) -> Column:
    """Stemmed runs of a-z and 0-9 without stop words; null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(found, lambda x: ~x.isin(K.STOP)), stem)


def bigrams(toks: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(toks) - 1), lambda i: F.concat_ws(" ", F.element_at(toks, i), F.element_at(toks, i + 1)))
    return F.when(F.size(toks) > 1, pairs).otherwise(F.array().cast("array<string>"))


def colours(text: Column | str) -> Column:
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda x: x.isin(K.COLOURS))


def strip_html(html: Column | str, keep: int = K.STORED_DESCRIPTION) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(_c(html), F.lit("")), "<[^>]+>", " "), r"(?U)\s+", " ")
    return F.substring(F.trim(bare), 1, keep)


def image_url(src: Column | str, width: int = K.IMAGE_WIDTH) -> Column:
    return F.concat(_c(src), F.when(F.contains(_c(src), F.lit("?")), "&").otherwise("?"), F.lit(f"width={width}"))


def domain(d: Column | str) -> Column:
    """Trimmed, lower-cased, without scheme, path and a leading ``www.``."""
    bare = F.regexp_replace(F.lower(F.trim(_c(d))), "^https?://", "")
    return F.regexp_replace(F.split_part(bare, F.lit("/"), F.lit(1)), r"^www\.", "")


def colourway(title: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(title)), r"\s*[-|~(].*$", ""))


def trait_text(t: Column | str) -> Column:
    bare = F.btrim(F.trim(_c(t)), F.lit(".,;:!\"'"))
    return F.regexp_replace(F.lower(bare), r"\s+", " ")


def clean_traits(ts: Column | str) -> Column:
    """Normalised, without banned labels and long phrases, first of equals."""
    good = F.filter(F.transform(_c(ts), trait_text), lambda t: (t != "") & ~t.rlike(K.BANNED_TRAITS) & (F.size(F.split(t, " ")) <= K.TRAIT_MAX_WORDS))
    return F.array_distinct(good)


def keyword_category(t: Column | str) -> Column:
    """The category of the first keyword, in list order, that the padded text contains."""
    padded, out = F.concat(F.lit(" "), F.lower(F.coalesce(_c(t), F.lit(""))), F.lit(" ")), None
    for word, name in K.KEYWORDS:
        hit = F.contains(padded, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def is_junk(title: Column | str) -> Column:
    return _c(title).rlike(K.JUNK)


def joined(names: Column) -> Column:
    """"a, b and c"."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(names, 1)).otherwise(F.concat(head, F.lit(" and "), F.element_at(names, -1)))


def json_list(reply: Column | str) -> Column:
    """A list of strings from a reply: the whole text as JSON, else its bracketed part, else its lines that aren't blank,
    without bullets, blanks and quotes at both ends."""
    r = _c(reply)
    full = F.filter(F.split(r, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)\s+", "") != "")
    lines = F.transform(full, lambda x: F.btrim(x, F.lit("-*• \t\"'")))
    return F.coalesce(F.from_json(r, "array<string>"), F.from_json(F.regexp_extract(r, r"(?s)\[.*\]", 0), "array<string>"), lines)


def usd(price: Column | str, currency: Column | str) -> Column:
    """Price in dollars; unknown currencies count as dollars, null prices stay null."""
    rates = F.create_map(*[F.lit(x) for kv in K.FX.items() for x in kv])
    return _c(price) * F.coalesce(F.try_element_at(rates, _c(currency)), F.lit(1.0))
