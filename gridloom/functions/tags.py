"""Tag maps: predicates that are never null, numbers in text, allow lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(tags: Column, key: str) -> Column:
    return tags[key]


def has(tags: Column, key: str, *values: str) -> Column:
    """The tag has one of ``values``; false where it is missing."""
    return F.coalesce(tags[key].isin(*values), F.lit(False))


def any_of(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def only(tags: Column, keys) -> Column:
    """The map without the keys that are not listed."""
    return F.map_filter(tags, lambda k, v: k.isin(*keys))


def tag_maps(tag_kv, key: str = "tag_id"):
    """One row per tag set: its tags as a map."""
    return tag_kv.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("tags"))


def tag_text(tags: Column) -> Column:
    """The map as sorted ``k=v`` pairs."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


# ---- voltages


def _parts(raw: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


_INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"


def volts(raw: Column) -> Column:
    """The voltages of a tag value as numbers; null unless all parts are whole numbers above 0."""
    parts = _parts(raw)
    fine = F.forall(parts, lambda x: x.rlike(_INTEGER)) & (F.size(parts) > 0)
    numbers = F.transform(parts, lambda x: F.replace(x, F.lit("_"), F.lit("")).try_cast("long"))
    return F.when(fine & F.forall(numbers, lambda n: F.coalesce(n > 0, F.lit(False))), numbers)


#: Least volts of a bucket, its state and its name, from the top.
VOLTAGE_BUCKETS = ((300_000, "ultra_high_voltage", "high_400"), (150_000, "extra_high_voltage", "high_220"), (35_000, "high_voltage", "high_110"), (1_000, "medium_voltage", "medium"), (0, "low_voltage", "low"))


def voltage_style(raw: Column) -> Column:
    """Struct (state, bucket): the bucket of the largest voltage; more than one voltage is a state of its own."""
    v = volts(raw)
    top = F.array_max(v)
    state = bucket = F.lit(None).cast("string")
    for least, s, b in reversed(VOLTAGE_BUCKETS):
        state, bucket = F.when(top >= least, F.lit(s)).otherwise(state), F.when(top >= least, F.lit(b)).otherwise(bucket)
    blank = F.trim(F.coalesce(raw, F.lit(""))) == ""
    state = F.when(blank, "missing").when(v.isNull(), "unparseable").when(F.size(v) > 1, "multiple_voltage").otherwise(state)
    return F.struct(state.alias("state"), F.coalesce(F.when(~blank, bucket), F.lit("unknown")).alias("bucket"))


def voltage_label(raw: Column) -> Column:
    """Kilovolts joined by slashes, without needless decimals; the raw text, or a default, where they cannot be read."""
    v = volts(raw)
    one = lambda n: F.when(n % 1000 == 0, (n / 1000).cast("long").cast("string")).otherwise((n / 1000).cast("string"))
    return F.when(v.isNotNull(), F.concat(F.array_join(F.transform(v, one), "/"), F.lit(" kV"))).otherwise(F.coalesce(F.when(raw != "", raw), F.lit("voltage unknown")))
