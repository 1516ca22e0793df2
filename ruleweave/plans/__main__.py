"""Runs a Python file that fills a rule book, and prints tables: python -m ruleweave.plans FILE [--dump TABLE]...

The file defines program(book).
"""

from __future__ import annotations

import argparse
import runpy

from pyspark.sql import SparkSession

from .rules import RuleBook


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m ruleweave.plans")
    parser.add_argument("file")
    parser.add_argument("--dump", action="append", default=[])
    parser.add_argument("--folder", help="where durable tables live")
    chosen = parser.parse_args(args)
    book = RuleBook(SparkSession.builder.getOrCreate(), chosen.folder)
    runpy.run_path(chosen.file)["program"](book)
    for name in chosen.dump:
        print(book.dump(name))


if __name__ == "__main__":
    main()
