"""limpida: mail and document cleaning as Spark DataFrame operators."""

from limpida.options import CleaningOptions, PiiMode

__version__ = "0.1.0"

__all__ = ["CleaningOptions", "PiiMode", "__version__"]
