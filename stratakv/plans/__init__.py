"""Plan building blocks: distributed ordering, the visible relation, and read-path choice."""
