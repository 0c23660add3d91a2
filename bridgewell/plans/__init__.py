"""Part of bridgewell: plans."""
