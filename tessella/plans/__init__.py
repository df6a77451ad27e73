"""The engine's queries; importing this package registers all of them."""

from . import chunk_queries, placement_queries, replay_queries, source_queries, stream_queries, telemetry_queries

__all__ = ["chunk_queries", "placement_queries", "replay_queries", "source_queries", "stream_queries", "telemetry_queries"]
