"""Training-data operators: toxicity, near duplicates, packing, sharding, scoring, language, tokens, fingerprints.

Nothing else in the library imports this subpackage; ``queries.py`` holds its query keys."""

from offerlake.session import ship_by_value

# Python stages carry this subpackage's functions with them, so executors need no installed copy.
ship_by_value(__name__)
