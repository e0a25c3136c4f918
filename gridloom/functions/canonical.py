"""Identities of JSON texts, whatever the order of their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """The compact form of a JSON text: keys in order at every depth, no blanks, characters unescaped where they may be, numbers by value (1.50 is 1.5, 2.0 is 2).

    The order of lists stays. Null for what is no JSON and for objects that state a key twice. Numbers with an exponent or of more than 38 digits are doubles, so of these only about 16 digits tell them apart."""
    return F.to_json(F.try_parse_json(text))


def json_identity(text: Column, prefix: str = "", digits: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the canonical form; null where there is none."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(text), 256), 1, digits))
