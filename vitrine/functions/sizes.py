"""Size labels to letters, with higher-order functions over a product's labels: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import constants as K


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def letters(label: Column) -> Column:
    """Letters named by a label, as an array; null if it names none."""
    t = F.regexp_replace(F.lower(F.trim(label)), "–", "-")
    t = F.trim(F.regexp_replace(t, r"\s*\(.*?\)\s*", " "))
    t = F.regexp_replace(t, r"^(size|sz|taille)\s*", "")
    of = _map(K.ALIASES)
    parts = F.transform(F.split(t, "[/-]"), lambda p: F.try_element_at(of, F.trim(p)))
    found = F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))
    one = F.try_element_at(of, t)
    return F.when(one.isNotNull(), F.array(one)).when(t.rlike("[/-]") & (F.size(found) > 0), found)


def numbers(label: Column) -> Column:
    return F.transform(F.slice(F.regexp_extract_all(label, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), 1, 2), lambda x: x.cast("double"))


def region_of(currency: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(K.REGIONS), currency), F.lit("US"))


def normalise(labels: Column, currency: Column, title: Column) -> Column:
    """``array<struct<label, canon>>`` of the labels of one product; what a number means depends on all of them."""
    title = F.coalesce(title, F.lit(""))
    region, bottoms = region_of(currency), title.rlike(K.BOTTOMS)
    values = F.flatten(F.transform(F.filter(labels, lambda x: letters(x).isNull()), numbers))
    is_123 = (F.array_max(values) <= 5) & (F.array_min(values) <= 1) & (F.size(F.array_distinct(values)) >= 2) & F.forall(values, lambda v: v == F.floor(v))
    waist = bottoms & F.forall(values, lambda v: v.between(22, 36))

    def canon(label: Column) -> Column:
        tag = F.upper(F.regexp_extract(label, K.REGION_TAG, 1))
        table = F.when(is_123, "123").when(waist | F.lower(label).startswith("w"), "WAIST").when(tag == "AU", "UK")
        table = table.when(tag.isin("US", "UK", "EU", "IT", "JP"), tag).when(region.isin("UK", "EU", "JP", "KR"), region).otherwise("US")
        of = F.create_map(*[x for name, t in K.NUMERIC.items() for x in (F.lit(name), _map(t))])
        named = F.transform(numbers(label), lambda n: F.try_element_at(F.element_at(of, table), n.cast("int")))
        return F.coalesce(letters(label), F.array_distinct(F.filter(named, lambda x: x.isNotNull())))

    none = F.array().cast("array<string>")
    shoes = title.rlike(K.SHOES) & ~bottoms
    return F.transform(labels, lambda x: F.struct(x.alias("label"), F.when(shoes, none).otherwise(canon(x)).alias("canon")))


def option_position(options: Column) -> Column:
    """Which option of a product is the size: by name, else the first whose values look like sizes."""
    named = F.filter(options, lambda o: F.coalesce(o["name"], F.lit("")).rlike(K.SIZE_OPTION))
    like = lambda v: letters(v).isNotNull() | v.rlike(r"\d")
    looks = F.filter(options, lambda o: (F.size(o["values"]) > 0) & (F.size(F.filter(o["values"], like)) >= F.greatest(F.lit(1), F.floor(F.size(o["values"]) / 2))))
    return F.coalesce(F.get(named, F.lit(0))["position"], F.get(looks, F.lit(0))["position"])


def order(letter: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in K.LETTERS]), letter)
    return F.when(at > 0, at - 1).otherwise(99)
