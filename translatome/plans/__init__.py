"""Views over the driver tables, and the registered queries with their SQL."""
