"""The same semantics over unbounded input, with Structured Streaming."""
