"""streaming of newsmill."""
