"""The op-log as a stream."""
