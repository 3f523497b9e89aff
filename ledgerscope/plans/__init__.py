"""Registered queries over the bench tables, their SQL counterparts, and the end-to-end run."""
