"""Order-line analytics and training-data operators on PySpark."""
