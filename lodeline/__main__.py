"""``spark-submit -m lodeline QUERY DATA_DIR OUT``: run a registered query over a data folder and write its rows as parquet."""

from __future__ import annotations

import argparse

from lodeline.plans.queries import queries
from lodeline.session import session


def main(argv: list[str] | None = None) -> int:
    known = queries()
    p = argparse.ArgumentParser(prog="lodeline", description=__doc__)
    p.add_argument("query", choices=sorted(known))
    p.add_argument("data")
    p.add_argument("out")
    p.add_argument("--master")
    a = p.parse_args(argv)
    spark = session("lodeline", a.master)
    known[a.query](spark, a.data).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
