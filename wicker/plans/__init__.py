"""Query catalogue: operators bound to the driver tables."""
