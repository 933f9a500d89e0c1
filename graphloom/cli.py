"""Command line: open tables, run text queries, explain or count.

python -m graphloom.cli TABLES_DIR [-q QUERY | -f FILE] [--explain] [--stats] [--dot FOLDER]
Without a query, lines are read from standard input; @FILE runs a file, help lists the operators.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from graphloom.functions.stringify import stringified
from graphloom.operators import updates
from graphloom.operators.lower import run
from graphloom.plans import logical as L
from graphloom.plans.parser import OPERATORS, parse
from graphloom.sources.dot import write_dot
from graphloom.sources.tables import from_tables

UPDATES = (L.CreateNode, L.CreateRel, L.UpdateNode, L.Remove)


def execute(graph, text: str, explain: bool = False):
    """Run one query, print its result, and return the graph after it."""
    plan = parse(text)
    if explain:
        print(L.describe(plan))
    if isinstance(plan, UPDATES):
        return updates.apply(graph, plan)
    df = run(graph, plan)
    if explain:
        df.explain("formatted")
    stringified(df).show(50, 20)
    return graph


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("tables")
    p.add_argument("-q", "--query")
    p.add_argument("-f", "--file")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--dot")
    a = p.parse_args(args)
    graph = from_tables(SparkSession.builder.appName("graphloom").getOrCreate(), a.tables)
    if a.stats:
        graph.stats().show(100)
    if a.dot:
        write_dot(graph, a.dot)
    lines = [a.query] if a.query else open(a.file) if a.file else [] if a.stats or a.dot else sys.stdin
    for line in lines:
        line = line.strip()
        if line == "help":
            print(*sorted(OPERATORS))
        elif line.startswith("@"):
            for inner in open(line[1:]):
                graph = execute(graph, inner.strip(), a.explain) if inner.strip() else graph
        elif line:
            graph = execute(graph, line, a.explain)


if __name__ == "__main__":
    main()
