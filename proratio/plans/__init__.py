"""The registered queries: domain tables derived from the given tables, and one plan per query."""
