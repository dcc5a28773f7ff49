"""Operators over op-logs, visible relations and extents."""
