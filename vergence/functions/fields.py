"""Field maps, time codes and sample points as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of speech for a character's share, and its least length.
CHARS_PER_SECOND, LEAST_SPEECH = 4.5, 1.5


def filled(value: Column) -> Column:
    """A value that isn't blank, else null."""
    return F.when(F.trim(value) != "", value)


def confirmed_value(confirmed: Column, field: Column) -> Column:
    """Of a map to structs with a value: the field's, unless it is blank or missing."""
    return filled(F.try_element_at(confirmed, field)["value"])


def machine_value(extracted: Column, field: Column) -> Column:
    """As confirmed_value(), but null where the extractor abstained."""
    entry = F.try_element_at(extracted, field)
    return F.when(~F.coalesce(entry["abstained"], F.lit(False)), filled(entry["value"]))


def resolved_value(extracted: Column, confirmed: Column, field: Column) -> Column:
    return F.coalesce(confirmed_value(confirmed, field), machine_value(extracted, field))


def required_fields(schema: Column) -> Column:
    """Names of a map to structs with `required`, in its order."""
    return F.filter(F.map_keys(schema), lambda k: F.coalesce(F.try_element_at(schema, k)["required"], F.lit(False)))


def publish_gate(schema: Column, extracted: Column, confirmed: Column) -> Column:
    """(missing, unconfirmed): required fields without any value, and with one that nobody confirmed."""
    open_ = F.filter(required_fields(schema), lambda k: confirmed_value(confirmed, k).isNull())
    return F.struct(F.filter(open_, lambda k: machine_value(extracted, k).isNull()).alias("missing"), F.filter(open_, lambda k: machine_value(extracted, k).isNotNull()).alias("unconfirmed"))


def publishable_values(schema: Column, confirmed: Column) -> Column:
    """Field to value, of the schema's fields that are confirmed."""
    keys = F.filter(F.map_keys(schema), lambda k: confirmed_value(confirmed, k).isNotNull())
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, confirmed_value(confirmed, k))))


def written_back(values: Column, asset_id: Column, version: Column, fresh: Column) -> Column:
    """Values with sources: this asset's old fields go, others stay, fresh ones lie over them."""
    others = F.map_filter(values, lambda _, v: F.coalesce(v["source"]["asset_id"] != asset_id, F.lit(True)))
    kept = F.map_filter(others, lambda k, _: ~F.map_contains_key(fresh, k))
    return F.map_concat(kept, F.transform_values(fresh, lambda _, v: F.struct(v.alias("value"), F.struct(asset_id.alias("asset_id"), version.alias("version")).alias("source"))))


def asset_ids(citations: Column) -> Column:
    """Distinct ids of the cited assets, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(citations, lambda c: c["asset_id"]), lambda i: i.isNotNull())))


def cited_version(citations: Column, asset_id: Column) -> Column:
    """The highest version of the asset that is cited."""
    return F.array_max(F.transform(F.filter(citations, lambda c: c["asset_id"] == asset_id), lambda c: c["version_no"]))


def timecode_seconds(value: Column) -> Column:
    """Seconds of HH:MM:SS; null for any other shape or range."""
    part = lambda i: F.regexp_extract(value, r"^(\d+):([0-5]?\d):([0-5]?\d)$", i).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def timecode(seconds: Column) -> Column:
    s = seconds.cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, s % 60)


def clip_bounds(start: Column, end: Column) -> Column:
    """(start, end): floor, and ceiling at least a second later, as time codes."""
    first = F.floor(start)
    return F.struct(timecode(first).alias("start"), timecode(F.greatest(F.ceil(end), first + 1)).alias("end"))


def speech_seconds(text: Column) -> Column:
    return F.greatest(F.length(text) / CHARS_PER_SECOND, F.lit(LEAST_SPEECH))


def sample_points(duration: Column, interval: float, cap: int) -> Column:
    """Even points from 0 on: one each interval, or fewer, further apart, if there would be more than the cap."""
    step = F.greatest(F.lit(float(interval)), duration / cap)
    count = F.least(F.lit(cap), F.ceil(duration / step)).cast("int")
    points = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.round(i * step, 3))
    return F.when(duration > 0, points).otherwise(F.array().cast("array<double>"))


def citation_key(text: Column) -> Column:
    return F.md5(text)


def inherited(confirmed: Column) -> Column:
    """Of a map to structs with a value: the filled ones, marked as inherited."""
    kept = F.map_filter(confirmed, lambda _, v: filled(v["value"]).isNotNull())
    return F.transform_values(kept, lambda _, v: F.struct(v["value"].alias("value"), F.lit(True).alias("inherited")))


def masked_values(values: Column, mask) -> Column:
    """A map of strings with each value masked."""
    return F.transform_values(values, lambda _, v: mask(v))


def with_key(values: Column, key: str, value: Column) -> Column:
    """A map with the key set, whether it was there or not."""
    return F.map_concat(without_keys(values, [key]), F.create_map(F.lit(key), value))


def without_keys(values: Column, keys: list[str]) -> Column:
    return F.map_filter(values, lambda k, _: ~k.isin(*keys))


#: Keys of an order that hold contacts.
CONTACT_KEYS = ["phone", "mobile", "email", "contact", "address", "receiver", "name"]


def without_contacts(entries: Column, mask) -> Column:
    """An array of string maps without their contact keys and with masked values."""
    return F.transform(entries, lambda e: masked_values(without_keys(e, CONTACT_KEYS), mask))
