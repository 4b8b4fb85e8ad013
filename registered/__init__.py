"""The queries the driver runs, over ticket data derived from its tables."""
