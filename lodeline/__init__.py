"""lodeline: structural and change analytics over repositories, written for Spark."""

from lodeline.session import cut, session, table

__all__ = ["cut", "session", "table"]
