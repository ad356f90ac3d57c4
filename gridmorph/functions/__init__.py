"""functions of the morphology engine."""
