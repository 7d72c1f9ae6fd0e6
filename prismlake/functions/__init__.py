"""prismlake.functions."""
