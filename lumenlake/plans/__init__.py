"""Plans over whole tables: incremental indexing, scratch tables and processing chains."""
