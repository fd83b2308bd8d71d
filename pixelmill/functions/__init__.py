"""Part of pixelmill."""
