"""streaming of the morphology engine."""
