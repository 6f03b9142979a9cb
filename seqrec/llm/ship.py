"""Sends the package's sources to the executors, so that tasks can import it wherever they run."""

from __future__ import annotations

from seqrec.session import ship

__all__ = ["ship"]
