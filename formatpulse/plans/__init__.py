"""Jobs and bindings: driver tables as domain rows, the gold rebuild, the query catalogue."""
