"""Sequence and embedding corpus analytics as Spark jobs."""

from strandkit.session import build_session, reliable_checkpoint, ship_package

__all__ = ["build_session", "reliable_checkpoint", "ship_package"]
