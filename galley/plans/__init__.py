"""Composed jobs: silver and gold builders, measures, reports, the whole run."""
