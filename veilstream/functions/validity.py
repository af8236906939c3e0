"""Checks that tell real secrets from placeholders, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least entropy in bits for each kind; 0 means no such check.
MIN_ENTROPY = {
    "api_key": 3.5,
    "bearer": 3.5,
    "jwt": 0.0,
    "token": 3.2,
    "webhook_secret": 3.2,
    "webhook_url": 0.0,
    "session": 3.0,
    "db_connection": 2.5,
    "private_key": 0.0,
    "oauth_code": 3.0,
    "aws_signature": 3.5,
    "verification_code": 0.0,
}


def entropy(value: Column) -> Column:
    """Shannon entropy in bits over code points; 0 for the empty string. Rounded so that exact thresholds hold."""
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(n > 0, F.round(bits, 9)).otherwise(0.0)


def valid_aws_key(value: Column) -> Column:
    return (F.length(value) == 20) & value.rlike(r"^.{4}[A-Z2-7]{16}\z")


def valid_jwt(value: Column) -> Column:
    """Three parts, the first a base64url JSON object with the key alg."""
    head = F.translate(F.element_at(F.split(value, r"\."), 1), "-_", "+/")
    padded = F.rpad(head, (F.ceil(F.length(head) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.coalesce((F.size(F.split(value, r"\.")) == 3) & F.array_contains(F.json_object_keys(text), "alg"), F.lit(False))


def valid(kind: str, value: Column) -> Column:
    if kind == "jwt":
        return valid_jwt(value)
    least = MIN_ENTROPY.get(kind, 3.0)
    enough = F.lit(True) if least == 0 else entropy(value) >= least
    return F.when(value.startswith("AKIA"), valid_aws_key(value)).otherwise(enough) if kind == "api_key" else enough


MODES = ("high_recall", "balanced", "high_precision")


def normalize_mode(mode: Column) -> Column:
    return F.when(mode.isin(*MODES), mode).otherwise(F.lit("balanced"))
