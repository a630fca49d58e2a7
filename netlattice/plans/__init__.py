"""Network-wide checks, and the registered queries."""
