"""Where label and feature matrices come from, and where reports go."""
