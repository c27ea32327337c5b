"""Whole analyses, composed of operators, and the queries that show each of them."""
