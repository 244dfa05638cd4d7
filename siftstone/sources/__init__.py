"""Part of siftstone: sources."""
