"""Football fixtures, forecasts and their evaluation as PySpark DataFrame operators."""
