"""Part of bridgewell: streaming."""
