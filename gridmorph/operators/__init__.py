"""operators of the morphology engine."""
