"""Part of bridgewell: operators."""
