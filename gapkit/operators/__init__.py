"""Order-aware, lookup, set and enrichment operators."""
