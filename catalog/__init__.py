"""The registered queries, each next to its SQL twin."""
