"""functions of newsmill."""
