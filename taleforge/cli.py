"""Command line: list the queries, run one, or check the installation."""

from __future__ import annotations

import argparse
import importlib.util
import os
import shutil
import sys
from dataclasses import dataclass


@dataclass(frozen=True)
class Check:
    """One finding; status is ok, warn or fail."""

    name: str
    status: str
    message: str
    hint: str = ""


def doctor() -> list[Check]:
    """All findings; the installation is sound if none has failed."""
    java = shutil.which("java") or os.environ.get("JAVA_HOME")
    out = [
        Check("python", "ok" if sys.version_info >= (3, 10) else "fail", sys.version.split()[0], "Python 3.10 or later"),
        Check("java", "ok" if java else "fail", java or "not found", "install Java 17 or set JAVA_HOME"),
    ]
    for module, needed in (("pyspark", True), ("pyarrow", True), ("pandas", True), ("numpy", True), ("tokenizers", False), ("tiktoken", False), ("sentencepiece", False)):
        there = importlib.util.find_spec(module) is not None
        out.append(Check(module, "ok" if there else "fail" if needed else "warn", "found" if there else "missing", "" if there else f"install {module}"))
    free = shutil.disk_usage(os.getcwd()).free / 1e9
    out.append(Check("disk", "ok" if free > 5 else "warn", f"{free:.0f} GB free", "intermediate tables need room"))
    return out


def main(arguments: list[str] | None = None) -> int:
    """0 if all went well."""
    parser = argparse.ArgumentParser(prog="taleforge", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    commands.add_parser("doctor", help="check the installation")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out", help="write the rows there as Parquet instead of showing some")
    args = parser.parse_args(arguments)
    if args.command == "doctor":
        found = doctor()
        for c in found:
            print(f"{c.status:4} {c.name}: {c.message}" + (f" ({c.hint})" if c.hint and c.status != "ok" else ""))
        return int(any(c.status == "fail" for c in found))
    from taleforge.plans import registry

    registry.load()
    if args.command == "list":
        for name, query in sorted(registry.QUERIES.items()):
            print(f"{name}: {(query.__doc__ or '').strip().splitlines()[0]}")
        return 0
    if args.query not in registry.QUERIES:
        print(f"no query is named {args.query}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    rows = registry.QUERIES[args.query](SparkSession.builder.getOrCreate(), args.tables)
    if args.out:
        rows.write.parquet(args.out)
    else:
        rows.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
