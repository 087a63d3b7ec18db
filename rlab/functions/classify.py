"""Row-wise rules that put values into classes. Null stays null unless a rule says otherwise."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_FIX_EXTENSION = "invalid"


def direction(delta: Column, up: float = 0.01, down: float = -0.01) -> Column:
    return F.when(delta.isNull(), "unknown").when(delta > up, "positive").when(delta < down, "negative").otherwise("neutral")


def stars(p: Column) -> Column:
    return F.when(p.isNull(), None).when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def size_bin(loc: Column, small: int = 100_000, medium: int = 300_000) -> Column:
    """Right-closed bins: a value on an edge belongs to the lower one. Zero and less are in no bin."""
    return F.when(loc <= 0, None).when(loc <= small, "small").when(loc <= medium, "medium").when(loc.isNotNull(), "large")


def project_age(year: Column, cutoff: int = 2019) -> Column:
    return F.when(year.isNull(), "unknown").when(year >= cutoff, "new").otherwise("mid-era")


#: Least scores at which a result counts as useful.
VIABLE = {"MRR": 0.20, "MAP": 0.15, "top_5": 0.35}


def viable(metric: Column, value: Column, limits: Mapping[str, float] = VIABLE) -> Column:
    """Whether a (metric name, value) is useful; unknown metrics give null."""
    out = F.lit(None).cast("boolean")
    for name, least in limits.items():
        out = F.when(metric == name, value >= least).otherwise(out)
    return out


def domain_type(source: Column, target: Column, group: list[str]) -> Column:
    return F.when(source.isin(group) & target.isin(group), "within").otherwise("cross")


def pair_key(a: Column, b: Column) -> Column:
    """The same key for (a, b) and (b, a)."""
    return F.concat_ws("||", F.least(a, b), F.greatest(a, b))


def agreement(one: Column, two: Column) -> Column:
    """struct(same_direction, same_sign, colour) of two deltas."""
    same = direction(one) == direction(two)
    sign = (F.signum(one) == F.signum(two)) & (F.signum(one) != 0)
    colour = F.when((one > 0) & (two > 0), "both_gain").when((one < 0) & (two < 0), "both_loss").otherwise("disagree")
    return F.struct(same.alias("same_direction"), sign.alias("same_sign"), colour.alias("colour"))


def joint_direction(first: Column, second: Column, limit: float = 0.01) -> Column:
    """Of two metrics' deltas: negative if either falls, positive if both rise, else mixed."""
    return F.when((first < -limit) | (second < -limit), "negative").when((first > limit) & (second > limit), "positive").otherwise("mixed")


def fix_type(exts: Column, primary: Column) -> Column:
    """Whether a fix touches no file with an extension, only the primary language, it and others, or only others."""
    distinct = F.array_distinct(exts)
    return (
        F.when(F.coalesce(F.size(distinct), F.lit(0)) <= 0, NO_FIX_EXTENSION)
        .when((F.size(distinct) == 1) & F.array_contains(distinct, primary), "mono_fix")
        .when(F.array_contains(distinct, primary), "poly_fix")
        .otherwise("other")
    )


def mono_fix_all(files: Column, primary: Column, ext) -> Column:
    """Only the files whose extension, by ``ext``, is the primary one."""
    return F.filter(files, lambda f: ext(f) == primary)


def multi_ext_flag(exts: Column) -> Column:
    return F.size(F.array_distinct(exts)) > 1


#: File extensions of the indexed languages.
LANGUAGE_EXTENSIONS = {
    "python": [".py"],
    "java": [".java"],
    "javascript": [".js", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".hpp", ".hh"],
    "go": [".go"],
}


def _suffix(path: Column) -> Column:
    """The last dot and what follows it; empty without a dot."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def is_indexable(path: Column, size: Column, language: Column, max_bytes: int = 2_000_000) -> Column:
    """A file of the language, not larger than ``max_bytes``."""
    known = F.create_map(*[x for lang, exts in LANGUAGE_EXTENSIONS.items() for x in (F.lit(lang), F.array(*map(F.lit, exts)))])
    return F.coalesce(F.array_contains(F.try_element_at(known, language), _suffix(path)), F.lit(False)) & (size <= max_bytes)


def file_language(path: Column, default: Column | None = None) -> Column:
    """The language of an extension, else the project's, else python."""
    known = F.create_map(*[F.lit(x) for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts for x in (e, lang)])
    found = F.try_element_at(known, _suffix(path))
    return F.coalesce(found, default if default is not None else F.lit(None), F.lit("python"))


def safe_ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(1e-9))


def commit_year_from(when: Column, year: int) -> Column:
    return F.year(when) >= year


def mean(value: Column) -> Column:
    """Mean of scores, which are summed as whole numbers of 1e-9: the order of the rows makes no difference."""
    return F.sum(F.round(value.cast("double") * 1e9).cast("decimal(28,0)")).cast("double") / F.count(value) / 1e9
