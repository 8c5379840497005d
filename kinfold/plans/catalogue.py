"""Modules that hold queries of the core."""

from kinfold.plans import checks, extras, general, linkage, scoring

FLAGSHIP = "decisions"
MODULES = [general, linkage, scoring, checks, extras]
