"""Pack sizes from descriptions, and prices per kilogram, litre or unit, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import AFTER, BEFORE

# What descriptions say about weights and packs, in the order in which the patterns are tried from the end.
UNITS = "kgs|kg|k|grs|gr|g|ml|cl|lt|l"
WEIGHED = r"(?iu)(\d+[.,]\d+)\s*kg\s*[x×]?\s*(\d+[.,]\d+)\s*(?:eur|€)\s*/\s*kg"
BARE_WEIGHED = r"(\d+,\d{2,3})\s*[x×X]\s*(\d+,\d{1,2})(?!\d)"
MULTIPACK = rf"(?i)(\d+)\s*[x×]\s*(\d+(?:[.,]\d+)?)\s*({UNITS}){AFTER}"
SIMPLE = rf"(?i)(\d+(?:[.,]\d+)?)\s*({UNITS}){AFTER}"
COUNTED = rf"(?i)(\d+)\s*un{AFTER}"
DOZENS = rf"(?i)(\d+)\s*dz{AFTER}"
HALF_DOZEN = r"(?iu)meia\s*d[uú]zia"
DOZEN = rf"(?iu){BEFORE}d[uú]zia{AFTER}"
EGGS = (rf"(?i)(\d+)\s*ovos?{AFTER}", rf"(?i){BEFORE}ovos?\s+(\d+){AFTER}")
#: Found wherever any of the patterns above is: texts without it need none of them.
ANY_PACK = r"(?iu)\d\s*[x×kgmcludo]|ovos?\s+\d|d[uú]zia"


def half_up(x: Column, digits: int) -> Column:
    """Rounds a double's halves up, on the binary product."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def number(x: Column) -> Column:
    """A number with a comma or a point; null if it is none."""
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def base_unit(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("kg", "k", "kgs", "g", "gr", "grs"), "kg").when(u.isin("l", "lt", "ml", "cl"), "L").otherwise("un")


def in_base(value: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("g", "gr", "grs", "ml"), value / 1000).when(u == "cl", value / 100).otherwise(value)


def _format(unit: Column, value: Column, kilos: Column | None = None, price: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    fields = (unit, "unidade_base"), (value.cast("double"), "formato_valor"), (none if kilos is None else kilos, "quantidade_kg"), (none if price is None else price, "preco_kg")
    return F.struct(*(c.alias(n) for c, n in fields))


def pack_format(description: Column) -> Column:
    """struct(unidade_base, formato_valor, quantidade_kg, preco_kg), by the first pattern that is found; one unit without any.

    A null or empty description is one unit.
    """
    s = F.coalesce(description, F.lit(""))
    part = lambda pattern, group: F.regexp_extract(s, pattern, group)
    out = _format(F.lit("un"), F.lit(1.0))
    for pattern in reversed(EGGS):  # the second form counts only where the first isn't found at all
        n = number(part(pattern, 1))
        plain = _format(F.lit("un"), F.lit(1.0))
        out = F.when(s.rlike(pattern), F.when(n.between(4, 60), _format(F.lit("un"), n)).otherwise(plain)).otherwise(out)
    out = F.when(s.rlike(DOZEN), _format(F.lit("un"), F.lit(12.0))).otherwise(out)
    out = F.when(s.rlike(HALF_DOZEN), _format(F.lit("un"), F.lit(6.0))).otherwise(out)
    out = F.when(s.rlike(DOZENS), _format(F.lit("un"), number(part(DOZENS, 1)) * 12)).otherwise(out)
    out = F.when(s.rlike(COUNTED), _format(F.lit("un"), number(part(COUNTED, 1)))).otherwise(out)
    unit = part(SIMPLE, 2)
    out = F.when(s.rlike(SIMPLE), _format(base_unit(unit), half_up(in_base(number(part(SIMPLE, 1)), unit), 3))).otherwise(out)
    unit = part(MULTIPACK, 3)
    out = F.when(s.rlike(MULTIPACK), _format(base_unit(unit), half_up(number(part(MULTIPACK, 1)) * in_base(number(part(MULTIPACK, 2)), unit), 3))).otherwise(out)
    for pattern in (BARE_WEIGHED, WEIGHED):
        kilos = number(part(pattern, 1))
        out = F.when(s.rlike(pattern), _format(F.lit("kg"), kilos, kilos, number(part(pattern, 2)))).otherwise(out)
    return F.when(s.rlike(ANY_PACK), out).otherwise(_format(F.lit("un"), F.lit(1.0)))


def price_per_base(net: Column, quantity: Column, pack: Column, target: Column | None = None) -> Column:
    """Price per kilogram, litre or unit of a line, in `target` if that is known and in the pack's own unit otherwise.

    Null if the target is a weight or volume and neither the description nor a weighed quantity tells it. A null price
    counts as 0 and a null or zero quantity as 1. The count of a pack of units wins over the quantity, and a printed price
    per kilogram, also of 0, over the pack's weight.
    """
    price = F.coalesce(net.cast("double"), F.lit(0.0))
    q = F.coalesce(F.nullif(quantity.cast("double"), F.lit(0.0)), F.lit(1.0))
    unit, value = pack["unidade_base"], pack["formato_valor"]
    wanted = unit if target is None else F.coalesce(F.nullif(target, F.lit("")), unit)
    each = lambda n: half_up(price / n, 4)
    weight = F.when((unit == wanted) & (value > 0), each(value * F.when(q >= 1, q).otherwise(1.0))).when((q > 0) & (q < 1), each(q))
    weight = F.when((wanted == "kg") & pack["preco_kg"].isNotNull(), half_up(pack["preco_kg"], 4)).otherwise(weight)
    count = F.when((unit == "un") & (value > 1), each(value)).when(q > 0, each(q))
    return F.when(F.isnan(price), None).when(wanted.isin("kg", "L"), weight).otherwise(count)
