"""Column-level helpers (``-> Column``): all built-in Spark expressions, codegen friendly."""

from .keys import card_key, user_key
from .mathcols import bce_with_logits, focal_with_logits, sigmoid
from .timecols import dow_monday0, epoch_seconds_ntz, hour_utc

__all__ = [
    "card_key", "user_key", "bce_with_logits", "focal_with_logits", "sigmoid",
    "dow_monday0", "epoch_seconds_ntz", "hour_utc",
]
