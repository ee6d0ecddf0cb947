"""Print the formatted physical plans of driver queries, as Spark would run them.

Usage: python tools/show_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyforge.plans import driver_queries as D  # noqa: E402
from tallyforge.session import local_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or ["unaccounted"]
    spark = local_session(8, scratch=tempfile.mkdtemp(prefix="tally-plans-"))
    qs = D.queries()
    for name in names:
        print(f"==== {name} ====")
        qs[name](spark, sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
