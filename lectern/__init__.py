"""lectern: Spark-native operators for multilingual, structured text corpora.

Every operator takes and returns DataFrames (or Columns), so a corpus of one
book and a corpus of billions of chapters run through the same plans.
"""

__version__ = "0.1.0"
