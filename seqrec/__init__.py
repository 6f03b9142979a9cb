"""seqrec: sequence-aware recommendation analytics on PySpark.

Every operator takes and returns a DataFrame.  Rating events use one
canonical long schema (see ``seqrec.sources.ratings.RATINGS_SCHEMA``).
"""

__version__ = "0.1.0"
