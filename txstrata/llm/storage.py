"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

from ..operators.rounds import Rounds, checkpoint_dir, stored

__all__ = ["Rounds", "checkpoint_dir", "stored"]
