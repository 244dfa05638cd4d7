"""Part of siftstone: plans."""
