"""The registered queries, their SQL twins and the tables they read."""
