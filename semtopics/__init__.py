"""semtopics: semantic text analytics as ordinary PySpark DataFrame transformations."""

__version__ = "0.1.0"
