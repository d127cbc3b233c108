"""NumPy kernels for what has no set-oriented form: peak picking, matching, grid fitting, beat metrics."""
