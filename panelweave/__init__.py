"""Spatial panel analytics as plain Spark DataFrame operators."""

from panelweave.session import get_session

__all__ = ["get_session"]
