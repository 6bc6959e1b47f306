"""Where tables and indexes are kept."""
