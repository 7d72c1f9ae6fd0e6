"""prismlake — spectral and wide-numeric analytics on Spark DataFrames.

Data model (see README): array form ``(dataset, sample_id, spectrum ARRAY<DOUBLE>, target)``
for row-local work and long form ``(dataset, sample_id, band, value, target)`` for
column-wise statistics. Every operator is DataFrame -> DataFrame and groups by ``dataset``.
"""

__version__ = "0.1.0"
