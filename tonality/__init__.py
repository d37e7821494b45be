"""tonality: Spark-native three-class sentiment analytics (negative, neutral, positive).

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame -> DataFrame
operators), ``sources`` (readers, writers, stand-in tables), ``plans`` (registered queries,
end-to-end chains, oracle SQL) and ``streaming`` (the scoring stream). ``session`` holds the
session, checkpoint-folder and sizing helpers.
"""

__version__ = "0.1.0"
