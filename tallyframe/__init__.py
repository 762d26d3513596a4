"""Reconcile marketplace exports with warehouse facts as Spark DataFrame plans."""
