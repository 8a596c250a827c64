"""Views over the driver tables, queries and their SQL."""
