"""Part of bridgewell: sources."""
