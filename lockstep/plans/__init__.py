"""Registered queries."""

from . import assembly, decoders, decoding, features, inference, participants, signals, stats, trials
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "assembly", "decoders", "decoding", "features", "inference", "participants", "signals", "stats", "trials"]
