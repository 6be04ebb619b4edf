"""All registered queries and their SQL."""

from tessera.plans import function_queries, markup_queries, reading_queries, registry, text_queries, view_queries  # noqa: F401  (they register theirs)

QUERIES, SQL = registry.QUERIES, registry.SQL
