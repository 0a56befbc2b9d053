"""Monitoring of machine-learning scoring pipelines on Spark.

``operators`` are DataFrame-to-DataFrame functions, ``plans`` whole jobs made of
them, ``sources`` the tables around a monitor and ``streaming`` its streams.
"""
