"""Stable keys and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal_form


def stable_key(book: Column, unit: Column, kind: Column, ordinal: Column, slug: Column) -> Column:
    """SHA-256 of the JSON of the parts in NFC, names in order. Null if a part is null."""
    nfc = normal_form("NFC")
    # The names that are hashed.
    parts = F.struct(nfc(book).alias("book"), ordinal.alias("ordinal"), nfc(slug).alias("slug"), kind.alias("type"), nfc(unit).alias("unit"))
    whole = book.isNotNull() & unit.isNotNull() & kind.isNotNull() & ordinal.isNotNull() & slug.isNotNull()
    return F.when(whole, F.sha2(F.to_json(parts), 256))


def card_key(book: Column, unit: Column, word_order: Column, card_type: Column, target: Column, other: Column | None = None) -> Column:
    """Stable key of a card: its slug is the type in lower case with hyphens, the target and, if there is one, the word it is told from."""
    kind = F.lower(F.replace(card_type, F.lit("_"), F.lit("-")))
    return stable_key(book, unit, F.lit("card"), word_order, F.concat_ws(":", kind, target, *([] if other is None else [other])))


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with its names sorted; nulls stay, as null."""
    parts = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def cache_key(provider: str, model: str, voice: str, text: Column, version: str) -> Column:
    """SHA-256 of the JSON array of what decides a synthesized sound."""
    return F.sha2(F.to_json(F.array(F.lit(provider), F.lit(model), F.lit(voice), text, F.lit(version))), 256)


def object_key(digest: Column) -> Column:
    return F.concat(F.lit("audio/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(".wav"))


def malformed(key: Column) -> Column:
    """Neither a SHA-256 nor a dotted key of known kind."""
    return ~(key.rlike("^[0-9a-f]{64}$") | key.rlike(r"^(w|s|ph|ex|c)\.?[\w.]*\d+[a-z]?$"))
