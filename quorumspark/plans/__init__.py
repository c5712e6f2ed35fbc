"""Queries over the input tables; importing this package registers them."""

from . import aggregating, filtering, recording, relating, sinks, streams, texts  # noqa: F401
