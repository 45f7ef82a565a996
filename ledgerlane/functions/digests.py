"""Digests over canonical text: keys, prompts, audit entries, confirmations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(text: Column, length: int = 64) -> Column:
    digest = F.sha2(text, 256)
    return digest if length == 64 else F.substring(digest, 1, length)


def idempotency_key(
    taxpayer: Column, period: Column, document: Column, action: Column, ruleset: Column
) -> Column:
    """The same decision always gives the same key; nothing in it varies between attempts."""
    return sha256_hex(F.concat_ws("|", taxpayer, period, document, action, ruleset), 32)


def prompt_hash(text: Column) -> Column:
    return sha256_hex(text, 16)


def cycle_id(taxpayer: Column, period: Column, ruleset: Column) -> Column:
    return F.concat_ws(":", F.lit("cycle"), taxpayer, period, ruleset)


def two_places(value: Column) -> Column:
    """A number in [0, 1] with two decimals, rounded from its binary value.

    ``format_string`` rounds the printed decimal half-up instead. The two differ only where the
    printed value ends in a 5 at the third place, and there are only a hundred such numbers.
    """
    ties = [(2 * i + 1) / 200 for i in range(100)]
    table = F.create_map(*[F.lit(x) for tie in ties for x in (str(tie), f"{tie:.2f}")])
    return F.coalesce(table[value.cast("string")], F.format_string("%.2f", value))


def python_float_text(value: Column) -> Column:
    """Shortest decimal text of a double below 1e16, in the notation Python prints."""
    text = value.cast("string")
    small = F.abs(value) >= 1e-4
    fixed = F.regexp_replace(value.cast("decimal(38,24)").cast("string"), "0+$", "")
    exponent = F.regexp_replace(
        F.regexp_replace(text, r"^(-?\d)\.0E", "$1E"), r"E-(\d)$", "E-0$1"
    )
    return (
        F.when(~text.contains("E"), text)
        .when(small & (F.abs(value) < 1), fixed)
        .otherwise(F.lower(exponent))
    )


def ascii_json(text: Column) -> Column:
    """Escape what lies outside printable ASCII as ``\\uXXXX``, by UTF-16 unit."""

    def escape(char: Column) -> Column:
        units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        return F.when(char.rlike("^[ -~]$"), char).otherwise(
            F.regexp_replace(units, "([0-9a-f]{4})", r"\\u$1")
        )

    def escaped(whole: Column) -> Column:
        chars = F.transform(
            F.sequence(F.lit(1), F.length(whole)), lambda i: escape(F.substring(whole, i, F.lit(1)))
        )
        return F.when(whole.rlike(r"^[ -~]*$"), whole).otherwise(F.array_join(chars, ""))

    # As the one element of an array the text is made once, not once for each use.
    return F.get(F.transform(F.array(text), escaped), F.lit(0))


def canonical_json(fields: dict[str, Column], escape: bool = True) -> Column:
    """Compact JSON object with sorted keys and explicit nulls, ASCII only unless told not to."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    text = F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})
    return ascii_json(text) if escape else text
