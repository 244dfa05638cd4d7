"""Part of siftstone: streaming."""
