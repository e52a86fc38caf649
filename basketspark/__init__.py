"""basketspark: retail price analytics as DataFrame jobs."""
