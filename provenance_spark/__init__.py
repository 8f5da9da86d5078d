"""Spark-native engine for telling machine-written text from human-written text.

Layout:

* ``sources``   - table reads, the labelled corpus, CSV/Parquet I/O, materialised stages, model registry
* ``functions`` - column expressions: text cleaning, tokenisation, losses, probabilities
* ``operators`` - DataFrame -> DataFrame operators: positions, sampling, profiling, features, heads
* ``plans``     - the named query registry used by ``__spark_entry__.py`` and ``bench.py``
* ``streaming`` - Structured Streaming scoring and incremental fitting
"""

__version__ = "0.1.0"
