"""The same path on a stream."""
