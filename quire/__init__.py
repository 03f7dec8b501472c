"""quire: document-corpus analytics on Spark.

Every public operator takes DataFrames (and plain parameters) and returns a
DataFrame.  Nothing is collected to the driver; Python runs only inside
Arrow-batched tasks where Spark's built-in functions cannot express the step.
"""

__version__ = "0.1.0"
