"""python -m palimpsest FOLDER [FLUSH_BYTES] [COMPACTION_TRIGGER]: answer command lines of standard input from a store."""

import sys

from palimpsest import session
from palimpsest.operators.flush import THRESHOLD
from palimpsest.plans.serve import repl
from palimpsest.plans.store import TRIGGER, Store


def main(args: list[str]) -> None:
    if not args:
        sys.exit(__doc__)
    flush_bytes, trigger = (int(a) if a else d for a, d in zip([*args[1:3], "", ""], (THRESHOLD, TRIGGER), strict=False))
    sys.stdin.reconfigure(newline="\n")
    spark = session()
    try:
        repl(Store(spark, args[0], flush_bytes, trigger), sys.stdin, sys.stdout)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
