"""Sources, adapters and sinks."""

from .adapters import orders_ties, tx_events, tx_lineitem
from .tables import read_table

__all__ = ["orders_ties", "read_table", "tx_events", "tx_lineitem"]
