"""The registered queries, with SQL that states the same results."""
