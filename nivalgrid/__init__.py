"""Gridded time-series analytics as PySpark DataFrame operators.

Sub-packages
------------
functions   Column -> Column: calendar, units, snow/energy physics, statistics
sources     readers, sinks, materialise-or-reuse, input checks
operators   DataFrame -> DataFrame building blocks (roll-up, areal, series, ...)
plans       composite analyses built from the operators
catalog     bindings of the operators to tables, each with its SQL counterpart
"""

__version__ = "0.1.0"
