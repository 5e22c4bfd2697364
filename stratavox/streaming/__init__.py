"""Jobs on append-only logs, batch and streaming."""
