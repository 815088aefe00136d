"""The engine's operators applied to the given tables, with SQL counterparts."""
