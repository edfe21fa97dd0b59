"""DataFrame-to-DataFrame operators; every input carries ``capture_id``."""
