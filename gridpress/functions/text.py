"""Whitespace, header keys and slugs as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as white space in cell text.
WHITESPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACE_RUN = WHITESPACE + "+"
NOT_SPACE = "[^" + WHITESPACE[1:]
EDGE_SPACE = f"^{WHITESPACE}+|{WHITESPACE}+$"
COMBINING_MARKS = r"[\u0300-\u036f]"

SLUG_MIN, SLUG_MAX = 3, 80
SLUG_PATTERN = "^[a-z0-9]+(-[a-z0-9]+)*$"
KEY_PATTERN = "^[a-z0-9]+(_[a-z0-9]+)*$"


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def strip(c: Column) -> Column:
    """Remove white space at both ends only."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def is_blank(c: Column) -> Column:
    # Mostly told by the first character.
    return ~c.rlike(NOT_SPACE)


def _accent_table(form: str, lowercase: bool) -> tuple[str, str]:
    """Single accented letters and the plain letter each decomposes to."""
    source, target = [], []
    for code in range(0x00A0, 0x2200):
        ch = chr(code)
        plain = re.sub(COMBINING_MARKS, "", unicodedata.normalize(form, ch))
        if lowercase:
            plain = plain.lower()
        if plain != ch and len(plain) == 1 and plain.isascii():
            source.append(ch)
            target.append(plain)
    return "".join(source), "".join(target)


def _key_table() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII that fold to one letter or digit, with it, and those that fold to several characters."""
    source, target, several = [], [], {}
    for code in range(0x0080, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = re.sub(COMBINING_MARKS, "", unicodedata.normalize("NFKD", chr(code))).lower()
        kept = re.sub("[^a-z0-9]+", "_", plain)
        if len(kept) == 1 and kept != "_":
            source.append(chr(code))
            target.append(kept)
        elif len(kept) > 1:
            several[chr(code)] = kept
    return "".join(source), "".join(target), several


_KEY_FROM, _KEY_TO, _KEY_SEVERAL = _key_table()
_KEY_SEVERAL_JSON, _KEY_SEVERAL_CLASS = json.dumps(_KEY_SEVERAL), f"[{''.join(_KEY_SEVERAL)}]"
_SLUG_FROM, _SLUG_TO = _accent_table("NFD", lowercase=False)


def header_key_expr(header: Column, position: Column) -> Column:
    """Column key of a header text, for bulk use over many headers.

    ``position`` is 0-based. Characters are folded one at a time, those of
    compatibility forms (ligatures, fractions, circled or full-width signs)
    to as many as they stand for; beyond U+FFFF nothing is folded.
    """
    # A map that the optimizer reads once; only texts that need it are cut into characters.
    several = F.from_json(F.lit(_KEY_SEVERAL_JSON), "map<string,string>")
    spread = F.array_join(F.transform(F.split(header, ""), lambda ch: F.coalesce(several[ch], ch)), "")
    header = F.when(header.rlike(_KEY_SEVERAL_CLASS), spread).otherwise(header)
    folded = F.lower(F.translate(F.regexp_replace(header, COMBINING_MARKS, ""), _KEY_FROM, _KEY_TO))
    slug = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    fallback = F.concat(F.lit("col_"), (position + 1).cast("string"))
    return F.when(slug == "", fallback).when(
        slug.rlike("^[0-9]"), F.concat(F.lit("col_"), slug)
    ).otherwise(slug)


def header_key(header: str, position: int) -> str:
    """Column key of one header text (a handful per table, driver side)."""
    text = re.sub(COMBINING_MARKS, "", unicodedata.normalize("NFKD", header)).lower()
    slug = re.sub(r"[^a-z0-9]+", "_", text).strip("_")
    if not slug:
        return f"col_{position + 1}"
    return f"col_{slug}" if slug[0].isdigit() else slug


def unique_keys(keys: list[str]) -> list[str]:
    """Number repeated keys ``k, k_2, k_3``, skipping names already taken."""
    taken: set[str] = set()
    last: dict[str, int] = {}
    out = []
    for key in keys:
        name = key
        if key in taken:
            n = last.get(key, 1) + 1
            while f"{key}_{n}" in taken:
                n += 1
            last[key] = n
            name = f"{key}_{n}"
        taken.add(name)
        out.append(name)
    return out


def header_keys(headers: list[str]) -> list[str]:
    return unique_keys([header_key(h, i) for i, h in enumerate(headers)])


def unique_keys_expr(keys: Column) -> Column:
    """:func:`unique_keys` over an ``array<string>`` column (one per table)."""

    def suffixed(key: Column, taken: Column) -> Column:
        # At most size(taken) suffixes can be in use, so one more always exists.
        candidates = F.transform(
            F.sequence(F.lit(2), F.size(taken) + 2),
            lambda n: F.concat(key, F.lit("_"), n.cast("string")),
        )
        return F.element_at(F.array_except(candidates, taken), 1)

    def step(taken: Column, key: Column) -> Column:
        name = F.when(F.array_contains(taken, key), suffixed(key, taken)).otherwise(key)
        return F.concat(taken, F.array(name))

    return F.aggregate(keys, F.expr("cast(array() as array<string>)"), step)


def slugify(name: Column) -> Column:
    """Suggested slug for a display name."""
    # Fixed value: the feminine ordinal sign reads as the letter a.
    plain = F.translate(F.regexp_replace(name, COMBINING_MARKS, ""), _SLUG_FROM + "ª", _SLUG_TO + "a")
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.lower(dashed), 1, SLUG_MAX)


def slug_valid(slug: Column) -> Column:
    return F.length(slug).between(SLUG_MIN, SLUG_MAX) & slug.rlike(SLUG_PATTERN)
