"""Load a registry's table and index into a store, say what is there, search it, or remove it.

    python -m gazelark.cli load cities cities.tsv STORE
    python -m gazelark.cli count cities STORE
    python -m gazelark.cli search cities STORE "Los Angelos"
    python -m gazelark.cli unload cities STORE
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.registries import Cities, Countries, Registry, Subdivisions
from .session import local_session
from .sources import readers, tables

KINDS: dict[str, tuple[type[Registry], tuple[str, ...]]] = {"countries": (Countries, readers.COUNTRY_COLUMNS), "subdivisions": (Subdivisions, readers.SUBDIVISION_COLUMNS), "cities": (Cities, readers.CITY_COLUMNS)}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for command, rest in (("load", ("file", "store")), ("count", ("store",)), ("search", ("store", "query")), ("unload", ("store",))):
        one = commands.add_parser(command)
        one.add_argument("kind", choices=sorted(KINDS))
        for name in rest:
            one.add_argument(name)
    given = parser.parse_args(args)
    spark = spark or local_session()
    kind, columns = KINDS[given.kind]
    registry, place = kind(), f"{given.store}/{given.kind}"
    if given.command == "load":
        registry.register(readers.tsv(spark, given.file, columns))
        registry.store(place)
        registry.unregister()
        return 0
    if given.command == "unload":
        tables.remove(spark, place)
        return 0
    if not tables.exists(spark, f"{place}/index"):
        print(f"{given.kind} aren't loaded in {given.store}")
        return 1
    registry.open(spark, place)
    if given.command == "count":
        print(registry.count)
    else:
        for row in registry.search(given.query, limit=10).select("id", "name", "score").collect():
            print(f"{row['id']}\t{row['name']}\t{row['score']:.3f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
