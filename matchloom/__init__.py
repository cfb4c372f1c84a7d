"""Session, event and evidence analytics as PySpark DataFrame operators."""
