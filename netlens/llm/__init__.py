"""Operators of a training-data pipeline over the ``documents`` / ``pages`` tables.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it is present."""
