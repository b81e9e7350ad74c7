"""End-to-end plans and the table of registered queries."""
