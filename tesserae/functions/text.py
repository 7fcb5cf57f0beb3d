"""Names, versions, numbers in JSON, times, maps and reference systems as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the choices of a reference system stand for; 0 is the input's, 5 a code of one's own.
CRS_CHOICES = {1: "EPSG:4326", 2: "EPSG:3857", 3: "EPSG:32618", 4: "EPSG:32619"}
CRS_CUSTOM = 5
_CORE = r"(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)"
_DOTTED = r"[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*"


def strict_number(value: Column) -> Column:
    """The number that a JSON text holds, numbers in strings included; null for booleans and all else."""
    bare = F.trim(F.when(value.rlike(r'^\s*".*"\s*$'), F.regexp_extract(value, r'^\s*"(.*)"\s*$', 1)).otherwise(value))
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))


def json_safe(value: Column) -> Column:
    """A value as text that JSON can hold: null stays null, structs, lists and maps become their JSON."""
    return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6))


def safe_name(name: Column, empty: str = "preset") -> Column:
    """A file name: letters, digits, spaces, ``-`` and ``_`` stay, others become ``_``; without any the name is ``empty``."""
    kept = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_"))
    return F.when(F.coalesce(kept, F.lit("")) == "", empty).otherwise(kept)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def fill_template(template: str, path: Column, index: Column) -> Column:
    """``{stem}`` and ``{index}`` (counted from 1) of a template."""
    return F.replace(F.replace(F.lit(template), F.lit("{stem}"), stem(path)), F.lit("{index}"), (index + 1).cast("string"))


def is_semver(version: Column) -> Column:
    return F.coalesce(version.rlike(rf"\A{_CORE}(-{_DOTTED})?(\+{_DOTTED})?\z"), F.lit(False))


def version_numbers(version: Column) -> Column:
    """The leading numbers of ``vX.Y.Z`` with any suffix; null if there are none."""
    digits = F.regexp_extract(F.trim(version), r"^[vV]?([0-9]+(\.[0-9]+)*)", 1)
    return F.when(digits != "", F.transform(F.split(digits, r"\."), lambda p: p.try_cast("long")))


def is_newer(latest: Column, current: Column) -> Column:
    """Whether ``latest`` is the greater by its numbers, missing ones counting 0; as text where one has none."""
    a, b = version_numbers(latest), version_numbers(current)
    zero = lambda v: v.isNull() | (v == F.array(F.lit(0).cast("long")))
    differ = F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))), lambda d: d != 0)
    return F.when(zero(a) | zero(b), (F.trim(latest) != F.trim(current)) & (latest > current)).otherwise(F.coalesce(F.get(differ, F.lit(0)) > 0, F.lit(False)))


def throttled(last: Column, now: Column, hours: float = 24) -> Column:
    """Whether less than ``hours`` have gone by since ``last``; a missing time never holds anything back."""
    gone = now.cast("timestamp").cast("double") - last.cast("timestamp").cast("double")
    return F.coalesce(gone < hours * 3600, F.lit(False))


def crs_choice(choice: Column, custom: Column, of_input: Column) -> Column:
    """The reference system that is written beside the coordinates; nothing is reprojected."""
    own = F.when(F.trim(custom) != "", F.trim(custom)).otherwise(of_input)
    out = F.when(choice == CRS_CUSTOM, own)
    for number, code in CRS_CHOICES.items():
        out = out.when(choice == number, code)
    return out.otherwise(of_input)


def merged(base: Column, over: Column) -> Column:
    """Two maps as one; of a key in both, ``over`` says. A null map counts as empty."""
    none = F.create_map().cast("map<string,string>")
    mine, his = F.coalesce(base, none), F.coalesce(over, none)
    return F.map_concat(F.map_filter(mine, lambda k, _: ~F.map_contains_key(his, k)), his)


def known_only(entries: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(entries, lambda k, _: k.isin(list(keys)))


def with_defaults(entries: Column, defaults: Mapping[str, str]) -> Column:
    """``entries`` without keys that no default names, and the defaults of those that are missing."""
    base = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    return merged(base, known_only(entries, list(defaults)))
