"""The registered queries: library operators over views of the given tables, each with its SQL twin."""
