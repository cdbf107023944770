"""quarry: a PySpark analytics engine over typed metadata, text, graphs and registers."""
