"""DataFrame-in, DataFrame-out operators; table columns are those of ``sources.schemas``."""
