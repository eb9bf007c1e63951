"""The index, search over it, and the registered queries."""
