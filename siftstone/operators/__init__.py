"""Part of siftstone: operators."""
