"""Event-log bottleneck analytics and training-data operators on PySpark."""
