"""Part of siftstone: functions."""
