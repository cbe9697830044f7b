"""plans of newsmill."""
