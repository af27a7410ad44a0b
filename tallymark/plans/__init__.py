"""From checks to plans and stored results."""
