"""Command line: list the queries, run one and write its rows, or show its plan.

python -m lexmill list
python -m lexmill run NAME TABLES OUT
python -m lexmill explain NAME TABLES
"""

from __future__ import annotations

import sys

from lexmill.plans import registry
from lexmill.session import build_session


def main(args: list[str]) -> int:
    queries = registry.queries()
    if args == ["list"]:
        for name, query in sorted(queries.items()):
            print(name, "-", (query.__doc__ or "").strip().split("\n")[0])
        return 0
    if len(args) == {"run": 4, "explain": 3}.get(args[0] if args else "", 0) and args[1] in queries:
        frame = queries[args[1]](build_session("lexmill"), args[2])
        if args[0] == "run":
            frame.write.mode("errorifexists").parquet(args[3])
        else:
            frame.explain("formatted")
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
