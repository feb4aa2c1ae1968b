"""siftwright: a Spark-first engine for e-mail evidence tables.

Everything is expressed as DataFrame plans; Python only runs where a binary format or a text
model leaves no built-in expression.
"""

__version__ = "0.1.0"
