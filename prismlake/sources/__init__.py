"""prismlake.sources."""
