"""prismlake.plans."""
