"""DataFrame -> DataFrame operators of the index engine."""
