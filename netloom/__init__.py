"""Network traffic analytics as Spark plans.

Public functions take and return DataFrames, so they compose with
``df.transform``; parameters are plain values or the frozen dataclasses in
``netloom.config``; every "now" is an explicit ``as_of``.
"""

__version__ = "0.1.0"
