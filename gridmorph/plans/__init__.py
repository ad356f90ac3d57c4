"""plans of the morphology engine."""
