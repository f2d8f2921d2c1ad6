"""Sources: the driver tables, the derived job tables, and file readers."""
