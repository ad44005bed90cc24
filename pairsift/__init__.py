"""Quality analytics for preference pairs and training text, on Spark."""
