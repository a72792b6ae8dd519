"""palimpsest: a key-value log as data.

A mutation log of keys, values, tombstones and expiries is the only state; snapshots, lookups,
liveness-reporting deletes, sorted runs, compaction, recovery and whole command logs are queries over it.
"""

from palimpsest.schema import COMMAND, MUTATION
from palimpsest.session import session

__all__ = ["COMMAND", "MUTATION", "session"]
