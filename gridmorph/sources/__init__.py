"""sources of the morphology engine."""
