"""meritflow: scoring, rating and weighting analytics for task marketplaces, on Spark.

Every operator takes DataFrames and returns a DataFrame, so jobs compose with
``df.transform``.  Parameters default to the values of the system being modelled.
"""

__version__ = "0.1.0"
