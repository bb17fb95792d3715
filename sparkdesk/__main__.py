"""Run named queries from the command line.

    python -m sparkdesk list
    python -m sparkdesk run QUERY SF_DIR [OUT_PATH]     # parquet at OUT_PATH, or a row count
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> int:
    from sparkdesk.plans.queries import QUERIES
    if not argv or argv[0] not in ("list", "run"):
        print(__doc__.strip())
        return 2
    if argv[0] == "list":
        for name in sorted(QUERIES):
            print(name)
        return 0
    if len(argv) < 3 or argv[1] not in QUERIES:
        print(__doc__.strip())
        return 2
    from sparkdesk.session import get_session
    spark = get_session()
    df = QUERIES[argv[1]](spark, argv[2])
    if len(argv) > 3:
        df.write.mode("errorifexists").parquet(argv[3])
        print(f"wrote {argv[3]}")
    else:
        print(f"{argv[1]}: {df.count()} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
