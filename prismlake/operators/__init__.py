"""prismlake.operators."""
