"""Scalar column functions (JVM-side built-ins only)."""

from .money import cents, cents_to_decimal, signed_amount
from .text import escape_pattern, patterns_regex, contains_text
from .timefmt import epoch_seconds, date_text, bound_epoch
from .ids import transaction_id

__all__ = [
    "cents", "cents_to_decimal", "signed_amount", "escape_pattern", "patterns_regex",
    "contains_text", "epoch_seconds", "date_text", "bound_epoch", "transaction_id",
]
