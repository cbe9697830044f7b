"""sources of newsmill."""
