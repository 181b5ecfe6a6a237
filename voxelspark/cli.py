"""Command line: ``python -m voxelspark.cli convert|slice|line|verify|info|restore`` or a file of such tasks.

A task file has blocks parted by ``---``; in a block ``command`` names the task and other lines are key=value.
"""

from __future__ import annotations

import argparse
import sys

YES, NO = {"true", "yes", "on"}, {"false", "no", "off"}


def parse_tasks(text: str) -> list[list[str]]:
    """Argument lists of a task file: # starts a comment, a yes is a bare flag, a no leaves the flag out."""
    tasks: list[list[str]] = []
    for block in text.split("\n---"):
        command, args = None, []
        for line in block.splitlines():
            key, _, value = (x.strip() for x in line.split("#", 1)[0].partition("="))
            if not key or key == "---":
                continue
            if key == "command":
                command = value
            elif value.lower() in YES:
                args.append(f"--{key}")
            elif value.lower() not in NO:
                args += [f"--{key}", value]
        if command:
            tasks.append([command, *args])
        elif args:
            raise ValueError("a block without a command")
    return tasks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="voxelspark")
    out.add_argument("--config")
    out.add_argument("--dry-run", action="store_true")
    sub = out.add_subparsers(dest="command")
    for name in ("convert", "slice", "line", "verify", "info", "restore"):
        p = sub.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--output")
        p.add_argument("--other")
        p.add_argument("--axis", choices=["x", "y", "z"], default="x")
        p.add_argument("--index", type=int, default=0)
        p.add_argument("--second", type=int, default=0)
        p.add_argument("--policy", default="strict")
        p.add_argument("--replicas", default="")
        for d in ("nx", "ny", "nz"):
            p.add_argument(f"--{d}", type=int, required=True)
    return out


def run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from . import api
    from .functions.values import ErrorPolicy
    from .meta import VolumeMeta
    from .operators.volume import read_volume
    from .sources.rawvol import read_raw

    spark = SparkSession.builder.getOrCreate()
    meta = VolumeMeta(args.nx, args.ny, args.nz)
    if args.command == "convert":
        api.convert(spark, args.input, meta, args.output, tuple(filter(None, args.replicas.split(","))))
        return 0
    volume = read_raw(spark, args.input, meta) if args.input.endswith(".raw") else read_volume(spark, f"{args.input}/base", meta)
    if args.command == "info":
        print(meta, f"grid {meta.grid}, raw bytes {meta.bytes}")
    elif args.command == "restore":
        api.restore(volume, args.output)
    elif args.command == "verify":
        found = api.check(read_raw(spark, args.other, meta), volume, ErrorPolicy(args.policy)).first()
        print(found)
        return 0 if found.passed else 1
    else:
        rows = volume.slice(args.axis, args.index) if args.command == "slice" else volume.line(args.axis, args.index, args.second)
        rows.write.parquet(args.output) if args.output else rows.show()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.config:
        code = 0
        with open(args.config) as f:
            for task in parse_tasks(f.read()):
                print(" ".join(task))
                code = code if args.dry_run else run(parser().parse_args(task)) or code
        return code
    if not args.command:
        parser().print_help()
        return 2
    return run(args)


if __name__ == "__main__":
    sys.exit(main())
