"""lotledger: closed-auction market analytics as plain Spark DataFrame jobs."""

from lotledger.session import build_session, prepare

__all__ = ["build_session", "prepare"]
