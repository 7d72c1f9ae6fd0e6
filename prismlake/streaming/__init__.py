"""prismlake.streaming."""
