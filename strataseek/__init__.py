"""strataseek: hybrid code and document retrieval as Spark DataFrames."""

__version__ = "0.1.0"
