"""scanmart: internet-scan observations to ranked, explainable account marts on Spark.

Every operator takes DataFrames and returns DataFrames; nothing is collected to the
driver. See README.md for the operator map.
"""

__version__ = "0.1.0"
