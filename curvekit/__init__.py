"""curvekit: set-oriented PySpark operators for plot pixels, survival curves and at-risk tables."""
