"""operators of newsmill."""
