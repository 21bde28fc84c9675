"""Driver-table shapes (``shapes``) and the registered queries with their
DuckDB oracles (``event_queries``, ``table_queries``, ``stat_queries``;
``catalog`` collects them, ``registry`` holds the maps)."""
