"""A PySpark-native analytics engine: evaluation, audit, selection and corpus operators as lazy DataFrames."""
