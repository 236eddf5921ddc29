"""Views, queries and their SQL."""
