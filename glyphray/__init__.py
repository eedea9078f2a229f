"""glyphray: medical-image text extraction as Spark DataFrame and streaming jobs."""

__version__ = "0.1.0"
