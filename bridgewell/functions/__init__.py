"""Part of bridgewell: functions."""
