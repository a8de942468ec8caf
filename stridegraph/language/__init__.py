"""A small expression language over naturals, rationals, intervals, sets, maps and graphs."""

from stridegraph.language.evaluate import run, run_file

__all__ = ["run", "run_file"]
