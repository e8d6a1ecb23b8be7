"""Stallwise: marketplace analytics as lazy Spark DataFrame, SQL and streaming operators."""
