"""Sources: the driver's tables and text-like files."""
