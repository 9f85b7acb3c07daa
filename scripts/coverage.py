"""Write COVERAGE.md: operator ids and the queries that exercise them."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.plans.catalog import REGISTRY  # noqa: E402


def table() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for q in REGISTRY.values():
        for c in q.covers:
            out.setdefault(c, []).append(q.name if q.sql else f"{q.name} (rows only)")
    return out


def order(c: str) -> tuple[str, int]:
    group, number = c.rsplit("-", 1)
    return group, int(number)


def main() -> None:
    rows = table()
    lines = ["# Coverage", "", "Operator ids of the survey and the registered queries that exercise them.", "", "| Operator | Queries |", "| --- | --- |"]
    lines += [f"| {c} | {', '.join(rows[c])} |" for c in sorted(rows, key=order)]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "COVERAGE.md"), "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
